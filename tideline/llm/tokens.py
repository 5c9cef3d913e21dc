"""Byte-level BPE ids for whole texts, through the tokenizers library, with each distinct piece encoded once a worker.

The pre-tokeniser of a byte-level BPE never joins a character that is no white space with white space after it, nor
a letter with a sign or digit after it, nor a single line end with a letter after it.  A text may therefore be cut there, and the ids of the text are those of the
pieces, one after the other.  Pieces repeat a lot, so a worker keeps the ids of the pieces it has met (bounded).  A new
piece of letters alone goes to the library's BPE model at once, others through its whole chain.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .words import IS_SPACE, Block, span_hashes

_INK = np.zeros(256, bool)  # ASCII that is surely no white space
_INK[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BREAK = np.zeros(256, bool)  # unlike a blank, never part of the word behind it
_BREAK[9:14] = True
_SIGN = np.zeros(256, bool)  # ASCII that is no letter; what is no ASCII may be one
_SIGN[:128] = ~_LETTER[:128]
_LEAD2 = np.zeros(256, bool)  # two bytes: U+00C0 to U+07FF hold no white space, U+0080 to U+00BF do
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)  # three bytes: the spaces begin with E1, E2 or E3
_LEAD3[0xE0] = True
_LEAD3[0xE4:0xF0] = True
#: Latin letters with at most one blank in front: one word for the pre-tokeniser.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level BPE writes each byte as a character: printed ones as themselves, the rest from U+0100 on.
_ALPHABET = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_CHARS = [_ALPHABET.get(b, chr(b)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each document, before a blank after what is surely no white space, about a word's letters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ink = _INK[data]
    high = data >= 0x80
    if high.any():
        tail = np.zeros(n, bool)
        tail[1:] = (data[1:] & 0xC0 == 0x80) & _LEAD2[data[:-1]]
        tail[2:] |= (data[2:] & 0xC0 == 0x80) & (data[1:-1] & 0xC0 == 0x80) & _LEAD3[data[:-2]]
        ink |= tail
    cut = np.zeros(n + 1, bool)
    cut[1:n] = IS_SPACE[data[1:]] & ink[:-1] | _LETTER[data[:-1]] & _SIGN[data[1:]]
    # Behind a line end only where it stands alone: of several white spaces the last is split from the others.
    cut[2:n] |= ink[:-2] & _BREAK[data[1:-1]] & _LETTER[data[2:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of texts; keeps the ids of up to ``limit`` distinct pieces."""

    def __init__(self, path: str | None = None, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.model = Tokenizer.from_file(path or default_tokenizer())
        self.model.encode_special_tokens = True
        self.limit = limit
        self.bpe = self.model.model
        words = [" the", "Hello", " \u00e9t\u00e9", "stra\u00dfe", " MiXed", "q"]
        self.direct = isinstance(self.bpe, BPE) and all(self._word(x.encode()) == self.model.encode(x, add_special_tokens=False).ids for x in words)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _word(self, piece: bytes) -> list[int]:
        if piece.isascii():
            x = piece.decode("ascii")
            x = _ALPHABET[0x20] + x[1:] if x[0] == " " else x
        else:
            x = "".join([_CHARS[b] for b in piece])
        return [t.id for t in self.bpe.tokenize(x)]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, number of ids of each, which piece each is)."""
        flat, sizes, order, rest = array("I"), array("i"), [], []
        for i, x in enumerate(pieces):
            if self.direct and _WORD.fullmatch(x.decode("utf-8", "replace")):
                ids = self._word(x)
                flat.extend(ids)
                sizes.append(len(ids))
                order.append(i)
            else:
                rest.append(i)
        for i in range(0, len(rest), 2048):
            for e in self.model.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in rest[i : i + 2048]], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                sizes.append(len(ids))
        return np.array(flat, np.uint32), np.array(sizes, np.int32), np.array(order + rest, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids, size, order = self._ids(pieces)
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, keys[order]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the block's texts one after the other as uint32, offsets of each text's ids)."""
        data, n = block.data, block.n
        starts = cuts(data, block.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        names, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == names[inside]
        if not known.all():
            if len(self.keys) + (~known).sum() > self.limit:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(names[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, names)
        at = at[which]
        size = self.size[at].astype(np.int64)
        to = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.at[at] - to[:-1], size)]
        return ids, to[np.searchsorted(starts, block.offsets)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; it outlives the task, so later tasks find its pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
