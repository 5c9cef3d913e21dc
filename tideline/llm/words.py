"""Vectorised words over whole Arrow text columns: NumPy passes over the bytes instead of a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; documents never share a word.  Words are named by 64-bit
hashes: a polynomial over the bytes modulo 2**64, then a mixing function.  Two given words share a name with a chance
of about 2**-64, so a vocabulary of 10**8 words has a clash with a chance of about 3 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd
STEP = 0xD6E8FEB86659FD93  # odd, joins words to shingles

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n."""
    if len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each data[start:end]."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_bytes(x: bytes) -> int:
    """The name of one word, as span_hashes gives it."""
    a = np.frombuffer(x, np.uint8)
    return int(span_hashes(a, np.array([0]), np.array([len(a)]))[0])


@dataclass
class Block:
    """Some rows of a batch: first row, bytes of their texts one after the other, and n + 1 offsets into these."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Block]:
    """Cut a text column into blocks of about ``limit`` bytes; a longer text is a block by itself. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield Block(first, data[off[first] : off[last]], off[first : last + 1] - off[first])
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document number) of the words; offsets bound the documents."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    change = edge.copy()
    change[1:-1] |= solid[1:] != solid[:-1]
    at = np.flatnonzero(change)
    words = solid[at[:-1]]
    starts, ends = at[:-1][words], at[1:][words]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_names(block: Block, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(names of the block's words in order, offsets of each document's words)."""
    starts, ends, doc = word_spans(block.data, block.offsets)
    names = span_hashes(LOWER[block.data] if lower else block.data, starts, ends)
    return names, np.searchsorted(doc, np.arange(block.n + 1))


def windows(names: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of all runs of k words that lie in one document, their offsets by document)."""
    counts = np.diff(offsets)
    out = np.maximum(counts - k + 1, 0)
    to = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out, out=to[1:])
    if not to[-1]:
        return np.zeros(0, U), to
    at = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], out)
    h = names[at]
    for i in range(1, k):
        h = h * U(STEP) + names[at + i]
    return mix(h), to


def shingles(names: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct k-word shingles of each document, sorted within it, and their offsets).

    A document of 1 to k - 1 words has its whole sequence as its one shingle, one without words has none.
    """
    h, to = windows(names, offsets, k)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), np.diff(to))
    for m in range(1, k):
        d = np.flatnonzero(counts == m)
        if len(d):
            x = names[offsets[d]]
            for i in range(1, m):
                x = x * U(STEP) + names[offsets[d] + i]
            h, doc = np.concatenate([h, mix(x ^ U(m))]), np.concatenate([doc, d])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
