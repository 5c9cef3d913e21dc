"""Operator 7: multiple-instance learning of toxicity: sentences are instances, documents bags with labels.

A sentence has the probability p = sigmoid(bias + sum of its words' weights) if it has a word with a weight, else 0. A
document's is the noisy-or 1 - (1 - leak) * product(1 - p): one offending sentence is enough.  Weights, bias and leak
are trained by ascent of the likelihood of document labels alone; the trained sentence scores then say where a
document offends: the code points of each sentence with p >= 0.5, in the order of the text, from its first letter to the
end of its last word.  Of equal ones the first is the worst.  Sentences end at . ! ? and line ends and at their wide
forms and the ellipsis.  Words that may get a weight are those whose presence goes with the label (log-likelihood ratio).

Null and empty texts have the leak as their score.  Repeated rows and rows without doc_id stay rows.  Without labels
every score is 0.5 / (number of labels + 1).  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sampling import fold, labelled_texts
from .words import LOWER, Block, U, blocks, span_hashes

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_LETTERS[ord("'")] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
#: The wide full stop, exclamation and question marks, and the ellipsis, in UTF-8.
_WIDE = tuple(x.encode() for x in "\u3002\uff01\uff1f\u2026")


def sentence_words(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, sentence number in the block, start byte, end byte) of each run of letters."""
    data = b.data
    if not len(data):
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 4
    letter, ends_here = _LETTERS[data], _END[data]
    if len(data) > 2 and (data >= 0xE2).any():
        for x, y, z in _WIDE:
            at = np.flatnonzero((data[:-2] == x) & (data[1:-1] == y) & (data[2:] == z))
            letter[at] = letter[at + 1] = letter[at + 2] = False
            ends_here[at + 2] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[b.offsets] = edge[0] = edge[-1] = True
    change = edge.copy()
    change[1:-1] |= letter[1:] != letter[:-1]
    at = np.flatnonzero(change)
    words = letter[at[:-1]]
    starts, ends = at[:-1][words], at[1:][words]
    stop = edge[:-1] | np.append(False, ends_here[:-1])
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(b.offsets, starts, side="right") - 1, np.cumsum(stop)[starts], starts, ends


@dataclass
class Bags:
    """The model: sorted word names with their weights."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    leak: float = 0.5

    def hits(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words with a weight, number of the weight)."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        where = np.flatnonzero(self.names[at] == names)
        return where, at[where]

    def sentences(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start and end byte in the block, probability) of each sentence with a hit."""
        names, doc, sent, start, end = sentence_words(b)
        where, k = self.hits(names)
        some, first, inverse = np.unique(sent[where], return_index=True, return_inverse=True)
        z = self.bias + np.bincount(inverse, weights=self.weights[k], minlength=len(some))
        return doc[where][first], start[np.searchsorted(sent, some)], end[np.searchsorted(sent, some, side="right") - 1], 1 / (1 + np.exp(-z))

    def scores(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score of each document; document, start and end in code points and probability of each sentence at 0.5 or
        more, in order)."""
        doc, start, end, p = self.sentences(b)
        clear = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b.n)
        bad = np.flatnonzero(p >= 0.5)
        points = np.append(0, np.cumsum(b.data & 0xC0 != 0x80))
        place = lambda x: points[x[bad]] - points[b.offsets[doc[bad]]]
        return 1 - (1 - self.leak) * np.exp(clear), doc[bad], place(start), place(end), p[bad]

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], most_words: int = 2000, rounds: int = 300, rate: float = 0.1, decay: float = 0.002) -> Bags:
        y = np.array([r[1] for r in rows], float)
        if not len(y) or not 0 < y.sum() < len(y):
            return cls(leak=float((y.sum() + 0.5) / (len(y) + 1)))
        parts, base, sents = [], 0, 0
        for b in blocks(pa.array([r[0] for r in rows], pa.string())):
            names, doc, sent, *_ = sentence_words(b)
            parts.append((names, doc + base, sent + sents))
            base += b.n
            sents += int(sent.max()) + 1 if len(sent) else 0
        names, doc, sent = (np.concatenate(x) for x in zip(*parts, strict=True))
        kinds, which = np.unique(names, return_inverse=True)
        pair = np.unique(which * np.int64(len(y)) + doc)  # a word counts once a document
        w, d = pair // len(y), pair % len(y)
        df, pos = np.bincount(w, minlength=len(kinds)), np.bincount(w, weights=y[d], minlength=len(kinds))
        rate0 = y.mean()
        share = (pos + 0.5 * rate0) / (df + 0.5)
        gain = pos * np.log(share / rate0) + (df - pos) * np.log((1 - share) / (1 - rate0))
        able = np.flatnonzero((df >= 4) & (share > rate0) & (gain > 10))
        able = np.sort(able[np.argsort(-gain[able], kind="stable")[:most_words]])
        model = cls(kinds[able], np.ones(len(able)), -2.0, float(min(0.2, rate0 / 2)))
        where, k = model.hits(names)
        some, first, inverse = np.unique(sent[where], return_index=True, return_inverse=True)
        bag, k = doc[where][first], k
        theta = np.concatenate([model.weights, [model.bias, np.log(model.leak / (1 - model.leak))]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            z = theta[-2] + np.bincount(inverse, weights=theta[:-2][k], minlength=len(some))
            p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
            leak = 1 / (1 + np.exp(-theta[-1]))
            clear = np.bincount(bag, weights=np.log1p(-p), minlength=len(y)) + np.log1p(-leak)
            clear = np.minimum(clear, -1e-9)
            # d log P(y) / d log(1 - p) is 1 for clean documents and -(1 - P) / P for the others.
            slope = np.where(y > 0, -np.exp(clear) / -np.expm1(clear), 1.0)
            gz = slope[bag] * -p / len(y)
            g = np.concatenate([np.bincount(k, weights=gz[inverse], minlength=len(able)) - decay * theta[:-2] / len(able), [gz.sum(), (slope * -leak).mean()]])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return cls(model.names, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


SPANS = "array<struct<start:long,end:long,score:double>>"


def score_toxicity(docs: DataFrame, model: Bags) -> DataFrame:
    """Per row: doc_id, score, offending (start, end and score of each sentence at 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2,000 words

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                s, doc, start, end, p = shared.value.scores(b)
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p)], ["start", "end", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).cast(pa.int64()), pa.array(s), lists], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, offending {SPANS}")


def op7_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Bags.fit(labelled_texts(docs, labels, "toxic", fold("doc_id", 5) != 0, cap=8000))
    out = score_toxicity(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["score"], -x["start"], x["end"])))  # the first of equals
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"),
        F.coalesce(-worst["col2"], F.lit(-1)).alias("worst_start"), F.coalesce(worst["end"], F.lit(-1)).alias("worst_end"),
    )
