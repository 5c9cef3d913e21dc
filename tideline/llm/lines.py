"""Operator 8: lines labelled as content or boilerplate by a linear-chain conditional random field.

A line with a word is one position of the chain; its features are bins of the shares of symbols, capitals, digits and
marks, of its length, of how it ends, and whether it repeats an earlier line.  The model is fitted on a bounded sample
of documents, from lines that are plainly prose or plainly not; the labels of all other lines are hidden, so the
gradient is the difference of two forward-backward runs, with the known labels clamped and free.  (Nothing marks lines
in the data, so there are no labels to learn from but these; neighbours decide lines that the rules leave open.)  Viterbi decoding
then labels every line of every document, and the share of words in content lines decides.

Null texts have no words: they fail the base rule and are not kept.  Repeated rows and rows without doc_id stay rows.
An empty table gives no row (the model is then all zeros).  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sampling import drawn, stretch
from .words import Block, U, blocks, mix, span_hashes, windows, word_spans

CONTENT, BOILERPLATE = 0, 1
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1


def _mask(chars) -> np.ndarray:
    x = np.zeros(256, np.int64)
    x[list(chars)] = 1
    return x


CLASSES = {"symbol": SYMBOL, "upper": _mask(range(65, 91)), "lower": _mask(range(97, 123)), "digit": _mask(range(48, 58)), "bang": _mask(b"!?"), "stop": _mask(b".,;:"), "high": _mask(range(0xC2, 256)), "web": _mask(b"@/\\_=")}


def running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


class Lines:
    """The lines with a word of a block, with what the rules and the model need of them."""

    def __init__(self, b: Block):
        data, off = b.data, b.offsets
        self.n_docs = b.n
        self.word_starts, self.word_ends, self.word_doc = word_spans(data, off)
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([off[:-1], breaks + 1])) if len(data) else np.zeros(0, np.int64)
        starts = starts[starts < len(data)]
        # A line ends at its break, or at its document's end, which is where the next line starts.
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ends = ends - ((ends > 0) & (data[np.maximum(ends, 1) - 1] == 10)) if len(ends) else ends
        first = np.searchsorted(self.word_starts, starts)
        n_words = np.searchsorted(self.word_starts, ends) - first
        has = n_words > 0
        self.starts, self.ends, self.n_words, first = starts[has], ends[has], n_words[has], first[has]
        self.doc = self.word_doc[first] if len(first) else np.zeros(0, np.int64)
        self.first_byte, self.last_byte = data[self.word_starts[first]], data[self.word_ends[first + self.n_words - 1] - 1]
        names = span_hashes(data, self.starts, self.ends)
        order = np.lexsort((np.arange(len(names)), names, self.doc))
        same = np.zeros(len(names), bool)
        if len(names):
            same[order[1:]] = (names[order[1:]] == names[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        self.repeats = same
        self.counts = {k: (s := running(m[data]))[self.ends] - s[self.starts] for k, m in CLASSES.items()}

    def features(self) -> np.ndarray:
        """Binary features, a row a line."""
        c, n = self.counts, np.maximum(self.n_words, 1)
        letters = np.maximum(c["upper"] + c["lower"] + c["high"], 1)
        size = np.maximum(self.ends - self.starts, 1)
        bins = lambda x, *edges: [x <= edges[0], *[(x > a) & (x <= b) for a, b in zip(edges, edges[1:], strict=False)], x > edges[-1]]
        cols = [np.ones(len(n), bool)]
        cols += bins(c["symbol"] / n, 0, 0.1, 0.5)
        cols += bins(c["upper"] / letters, 0.02, 0.15, 0.4, 0.7)
        cols += bins(c["bang"] / n, 0, 0.1, 0.5)
        cols += bins(c["digit"] / size, 0, 0.05, 0.2)
        cols += bins(c["web"] / n, 0, 0.2)
        cols += bins(self.n_words, 2, 5, 12, 40)
        cols += bins(size / n, 3.5, 9, 14)
        cols += [np.isin(self.last_byte, list(b".!?")), np.isin(self.last_byte, list(b",;:")), self.repeats]
        return np.stack(cols, axis=1).astype(np.float64) if len(n) else np.zeros((0, len(cols)))

    def plain(self) -> np.ndarray:
        """CONTENT or BOILERPLATE where that is plain, else -1."""
        c, n = self.counts, np.maximum(self.n_words, 1)
        letters = np.maximum(c["upper"] + c["lower"] + c["high"], 1)
        junk = (c["symbol"] >= 0.5 * n) | (c["upper"] >= 0.7 * letters) & (n >= 3) | (c["bang"] >= 0.5 * n) & (n >= 3) | self.repeats & (n >= 3)
        prose = ~junk & (n >= 6) & (c["symbol"] <= 0.02 * n) & (c["upper"] <= 0.3 * letters) & np.isin(self.last_byte, list(b".!?")) & ~self.repeats
        return np.where(junk, BOILERPLATE, np.where(prose, CONTENT, -1))


def base_counts(b: Block, lines: Lines) -> dict[str, np.ndarray]:
    """The base columns of each document of a block."""
    data, off, n = b.data, b.offsets, b.n
    word_off = np.searchsorted(lines.word_doc, np.arange(n + 1))
    symbols = running(SYMBOL[data])
    inside = running((data & 0xC0 != 0x80) & ~np.isin(data, [32, 9, 10, 11, 12, 13]))
    names = span_hashes(data, lines.word_starts, lines.word_ends)
    w, to = windows(names, word_off, 8)
    doc = np.repeat(np.arange(n), np.diff(to))
    # A name that holds the document sorts all windows at once; equal names in one document are equal windows.
    key = mix(w ^ mix(doc.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(w), bool)
    if len(w):
        eq = key[order[1:]] == key[order[:-1]]
        twin[order[1:]] |= eq
        twin[order[:-1]] |= eq
    mark = np.zeros(len(names) + 1, np.int64)
    at = np.flatnonzero(twin)
    at = word_off[:-1][doc[at]] + at - to[:-1][doc[at]]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + 8, -1)
    covered = running(np.cumsum(mark[:-1]) > 0)
    return {
        "n_words": np.diff(word_off),
        "word_chars": inside[off[1:]] - inside[off[:-1]],
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": np.bincount(lines.doc, weights=lines.repeats, minlength=n).astype(np.int64),
        "n_repeat_words": covered[word_off[1:]] - covered[word_off[:-1]],
    }


class Chain:
    """A linear-chain CRF of two labels: weights of features by label, of label pairs, and of the first label.

    Chains of one batch advance together, a position a step, longest chains first.
    """

    def __init__(self, n_features: int):
        self.w, self.t, self.s = np.zeros((n_features, 2)), np.zeros((2, 2)), np.zeros(2)

    @staticmethod
    def _layout(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first line of each chain, lines of each chain), longest first."""
        if not len(doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        n = np.diff(np.append(first, len(doc)))
        order = np.argsort(-n, kind="stable")
        return first[order], n[order]

    def viterbi(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best labels; ties go to content."""
        first, n = self._layout(doc)
        e = x @ self.w
        back = np.zeros((len(doc), 2), np.int8)
        if not len(n):
            return back[:, 0]
        score = self.s + e[first]
        for t in range(1, n[0]):
            k = int(np.searchsorted(-n, -t, side="left"))  # chains longer than t
            at = first[:k] + t
            step = score[:k, :, None] + self.t
            back[at] = step.argmax(axis=1)
            score[:k] = step.max(axis=1) + e[at]
        label = np.zeros(len(doc), np.int8)
        label[first + n - 1] = score.argmax(axis=1)
        for t in range(n[0] - 1, 0, -1):
            k = int(np.searchsorted(-n, -t, side="left"))
            at = first[:k] + t
            label[at - 1] = back[at, label[at]]
        return label

    def _expected(self, e: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(label probabilities of each line, expected label pairs, log of the partition functions' product)."""
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[first] = self.s + e[first]
        alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(n[0])]
        for t in range(1, n[0]):
            at = first[: alive[t]] + t
            a[at] = np.logaddexp.reduce(a[at - 1][:, :, None] + self.t, axis=1) + e[at]
        pairs = np.zeros((2, 2))
        z = np.logaddexp.reduce(a[first + n - 1], axis=1)
        for t in range(n[0] - 1, 0, -1):
            at = first[: alive[t]] + t
            both = a[at - 1][:, :, None] + self.t + (e[at] + b[at])[:, None, :]
            pairs += np.exp(both - z[: alive[t], None, None]).sum(axis=0)
            b[at - 1] = np.logaddexp.reduce(self.t + (e[at] + b[at])[:, None, :], axis=2)
        by_line = np.zeros(len(e))
        for i, f in enumerate(first):
            by_line[f : f + n[i]] = z[i]
        return np.exp(a + b - by_line[:, None]), pairs, float(z.sum())

    def fit(self, x: np.ndarray, doc: np.ndarray, known: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Chain:
        """Ascent (Adam) of the likelihood of the known labels, the others summed out."""
        first, n = self._layout(doc)
        if not len(n):
            return self
        barred = np.zeros((len(doc), 2))
        barred[known == CONTENT, BOILERPLATE] = barred[known == BOILERPLATE, CONTENT] = -1e4
        size = max(1, int((known >= 0).sum()))
        params = [self.w, self.t, self.s]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for i in range(1, rounds + 1):
            e = x @ self.w
            held, held_pairs, _ = self._expected(e + barred, first, n)
            free, free_pairs, _ = self._expected(e, first, n)
            diff = held - free
            grads = [x.T @ diff / size, (held_pairs - free_pairs) / size, diff[first].sum(axis=0) / size]
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                g = g - decay * p
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p += rate * (mi / (1 - 0.9**i)) / (np.sqrt(vi / (1 - 0.99**i)) + 1e-8)
        return self


def fit_chain(docs: DataFrame, cap: int = 1500, longest: int = 20_000) -> Chain:
    """The model, from at most 2 * cap documents of any length.  Of one with more than ``longest`` characters so many
    are taken, from a place that a hash of its key chooses, so no part of long texts is left out by rule."""
    rows = drawn(docs.select("doc_id", "text").where("text is not null"), "doc_id", cap).select("doc_id", stretch("text", "doc_id", longest).alias("text"))
    rows = rows.orderBy("doc_id", "text").collect()
    xs, ds, ks, base = [], [], [], 0
    for b in blocks(pa.array([r["text"] for r in rows], pa.string())):
        lines = Lines(b)
        xs.append(lines.features())
        ds.append(lines.doc + base)
        ks.append(lines.plain())
        base += b.n
    n = xs[0].shape[1] if xs else Lines(next(blocks(pa.array(["a"])))).features().shape[1]
    return Chain(n).fit(np.concatenate(xs), np.concatenate(ds), np.concatenate(ks)) if xs else Chain(n)


def label_lines(docs: DataFrame, chain: Chain, least_content: float = 0.3) -> DataFrame:
    """Per document: doc_id, the base columns, n_lines, n_content_lines, content_share (of words), base_failed, kept."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # a few dozen weights

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                lines = Lines(b)
                base = base_counts(b, lines)
                label = model.value.viterbi(lines.features(), lines.doc)
                good = label == CONTENT
                words = np.bincount(lines.doc, weights=lines.n_words * good, minlength=b.n)
                share = words / np.maximum(base["n_words"], 1)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                cols = {
                    "doc_id": batch.column(0).slice(b.first, b.n).cast(pa.int64()),
                    **{k: pa.array(v.astype(np.int64)) for k, v in base.items()},
                    "n_lines": pa.array(np.bincount(lines.doc, minlength=b.n)),
                    "n_content_lines": pa.array(np.bincount(lines.doc, weights=good, minlength=b.n).astype(np.int64)),
                    "content_share": pa.array(share),
                    "base_failed": pa.array(failed),
                    "kept": pa.array(~failed & (share >= least_content)),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label_lines(docs, fit_chain(docs))
