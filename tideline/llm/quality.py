"""Operator 6: quality by the vote of nearest labelled documents in a latent semantic space.

A document's features are its words and pairs of words, hashed, and beside them hashed trigrams of character shapes and
bins of how much it repeats itself and of its length; they are damped, weighted by inverse document frequency and
projected by a truncated SVD.  A bounded sample of labelled documents (``cap``, at most twice that) is projected and
broadcast; for every document the cosines with all of them are computed exactly, in blocks, and the nearest vote with
their similarity as weight.  Cosines count to five digits; of equal ones the earlier row of the sample is nearer.

Null and empty texts have no trigrams and are scored by the same vote. Repeated rows and rows without doc_id stay rows.
Without labels every score is 1.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sampling import fold, labelled_texts
from .words import Block, U, blocks, mix, windows, word_names

WORDS, BUCKETS = 4096, 2048
WORD_WEIGHT, SHAPE_WEIGHT, BIN_WEIGHT = np.float32(1.0), np.float32(0.5), np.float32(0.25)
REPEATS = (0.0, 0.02, 0.1, 0.3, 0.6)
LENGTHS = (0, 5, 20, 50, 200, 1000, 5000)
TERMS = WORDS + BUCKETS
WIDTH = TERMS + 2 * (len(REPEATS) + 1) + len(LENGTHS) + 1
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:192] = 1
_SHAPE[192:] = 97


def _binned(x: np.ndarray, edges: tuple) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="left")


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(number of feature, times) in a dense matrix of n documents and WIDTH columns, as float32."""
    n, off = b.n, b.offsets
    out = np.zeros((n, WIDTH), np.float32)
    shape = _SHAPE[b.data]
    if len(shape) > 2:
        tri = (shape[:-2] * np.uint32(0x9E3779B1) + shape[1:-1] * np.uint32(0x85EBCA77) + shape[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        inside = np.ones(len(tri), bool)  # trigrams that reach into the next document don't count
        for back in (1, 2):
            edge = off[1:-1] - back
            inside[edge[(edge >= 0) & (edge < len(tri))]] = False
        of = np.repeat(np.arange(n), np.diff(off))[: len(tri)]
        at = tri[inside] + of[inside] * np.int64(BUCKETS)
        out[:, WORDS:TERMS] = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS)
    names, to = word_names(b)
    count = np.diff(to)
    doc = np.repeat(np.arange(n), count)
    pairs, po = windows(names, to, 2)
    at = np.concatenate([names % U(WORDS), pairs % U(WORDS)]).astype(np.int64) + np.concatenate([doc, np.repeat(np.arange(n), np.diff(po))]) * WORDS
    out[:, :WORDS] = np.bincount(at, minlength=n * WORDS).reshape(n, WORDS)
    again = np.zeros(len(names), bool)
    again[1:] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    w, wo = windows(names, to, 4)
    wd = np.repeat(np.arange(n), np.diff(wo))
    key = np.sort(mix(w ^ mix(wd.astype(U) + U(1))))  # only its number of distinct values by document is needed
    dup = np.zeros(n)
    if len(w):
        order = np.argsort(mix(w ^ mix(wd.astype(U) + U(1))), kind="stable")
        eq = np.append(False, key[1:] == key[:-1])
        dup = np.bincount(wd[order], weights=eq, minlength=n)
    at = TERMS
    for share in (np.bincount(doc, weights=again, minlength=n) / np.maximum(count, 1), dup / np.maximum(np.diff(wo), 1)):
        out[np.arange(n), at + _binned(share, REPEATS)] = 1
        at += len(REPEATS) + 1
    out[np.arange(n), at + _binned(count, LENGTHS)] = 1
    return out


def damped(x: np.ndarray, own: bool = False) -> np.ndarray:
    """Shares of words and of trigrams under a root, so documents of any length compare, beside the bins; in place if
    x is the caller's own.  Words weigh most."""
    out = x if own else x.copy()
    for part, weight in ((slice(0, WORDS), WORD_WEIGHT), (slice(WORDS, TERMS), SHAPE_WEIGHT)):
        out[:, part] /= np.maximum(out[:, part].sum(axis=1, keepdims=True), 1)
        np.sqrt(out[:, part], out=out[:, part])
        out[:, part] *= weight
    out[:, TERMS:] *= BIN_WEIGHT
    return out


@dataclass
class Neighbours:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (damped(x) * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def votes(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest, block by block."""
        if not len(self.labels):
            return np.ones(len(x))
        out, k = np.empty(len(x)), min(self.k, len(self.labels))
        for i in range(0, len(x), rows):
            cos = self.project(x[i : i + rows]) @ self.vectors.T
            n = cos.shape[1]
            code = np.rint(cos.astype(float) * 1e5).astype(np.int64) * n + np.arange(n)[::-1]  # larger, or equal and earlier
            near = np.argpartition(-code, k - 1, axis=1)[:, :k]
            cos = np.rint(cos * 1e5) / 1e5
            weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6).astype(float) ** 8
            out[i : i + rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], dims: int = 48, k: int = 15) -> Neighbours:
        if not rows:
            return cls(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
        a, at = np.empty((len(rows), WIDTH), np.float32), 0  # the one large matrix of the driver
        for lo in range(0, len(rows), 64):
            for b in blocks(pa.array([r[0] for r in rows[lo : lo + 64]], pa.string())):
                a[at : at + b.n] = features(b)
                at += b.n
        df = sum((a[lo : lo + 256] > 0).sum(axis=0) for lo in range(0, len(a), 256))
        idf = (np.log((1 + len(a)) / (1 + df)) + 1).astype(np.float32)
        for lo in range(0, len(a), 256):
            damped(a[lo : lo + 256], own=True)
        a *= idf
        # The right singular vectors by subspace iteration from a fixed start: the same on every machine.
        dims = min(dims, *a.shape)
        q = np.random.default_rng(5).standard_normal((a.shape[1], dims + 8)).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(a.T @ (a @ q))
        u, _, vt = np.linalg.svd(a @ q, full_matrices=False)
        model = cls(idf, np.ascontiguousarray((q @ vt.T)[:, :dims], np.float32), np.zeros((0, 1)), np.array([r[1] for r in rows], float), k)
        v = a @ model.axes
        model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        return model


def score_quality(docs: DataFrame, model: Neighbours) -> DataFrame:
    """Per row: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * cap vectors of 48 numbers, and the axes

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), 1 << 19):
                for lo in range(0, b.n, 256):
                    hi = min(b.n, lo + 256)
                    a, z = b.offsets[lo], b.offsets[hi]
                    s = shared.value.votes(features(Block(0, b.data[a:z], b.offsets[lo : hi + 1] - a)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first + lo, hi - lo).cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Neighbours, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for b in blocks(batch.column(at), 1 << 19):
                for lo in range(0, b.n, 256):
                    hi = min(b.n, lo + 256)
                    a, z = b.offsets[lo], b.offsets[hi]
                    keep.append(shared.value.votes(features(Block(0, b.data[a:z], b.offsets[lo : hi + 1] - a))) >= least)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)


def fit_quality(docs: DataFrame, labels: DataFrame, cap: int = 3000) -> Neighbours:
    return Neighbours.fit(labelled_texts(docs, labels, "quality", fold("doc_id", 4) != 2, cap))


def op6_nearest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, fit_quality(docs, labels)).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
