"""Operator 5: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into pieces of the sequence length; what is left over, shorter, is packed.  Groups are drawn
by a hash of doc_id, are packed by themselves, and hold about ``group_size`` documents at any size of the corpus, so
packing takes no more memory as the corpus grows and one group never waits for another.

Null texts are empty and have the end id alone.  Rows without doc_id are left out.  Rows that repeat a doc_id are
packed each by itself.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import encoder
from .words import blocks


class Tournament:
    """Bins in order; each inner node holds the largest room below it, so the first bin with room is found in log n."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.size)

    def first_fit(self, n: int) -> int:
        """Put n into the first bin with room for it; the caller keeps one bin for each item, so there is one."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            if most[i] < n:
                i += 1
        at = i - self.size
        most[i] -= n
        i //= 2
        while i:
            a, b = most[2 * i], most[2 * i + 1]
            top = a if a >= b else b
            if most[i] == top:
                break
            most[i] = top
            i //= 2
        return at


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length; longest first, ties in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, filled = Tournament(len(lengths), room), {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = tree.first_fit(n)
        bins[i], offsets[i] = at, filled.get(at, 0)
        filled[at] = filled.get(at, 0) + n
    return bins, offsets


def document_pieces(docs: DataFrame, length: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """Per row: doc_id, doc_tokens, crcs (of each piece's ids, in order)."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for b in blocks(batch.column(1), 1 << 21):
                ids, to = encode.encode(b)
                ids, to = np.insert(ids, to[1:], end_id).astype("<u4"), to + np.arange(len(to))
                raw = memoryview(ids).cast("B")
                crcs = [[zlib.crc32(raw[4 * i : 4 * min(i + length, z)]) for i in range(a, z, length)] for a, z in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(np.diff(to)), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, length: int = 1024, end_id: int = 0, tokenizer: str | None = None, group_size: int = 8192, seed: int = 7) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and padded_to.

    A sequence is padded to ``length`` unless it is filled to a power of two.  sequence_id is the group's number
    times 2**32 plus the sequence's number in the group.
    """
    groups = max(1, -(-docs.count() // group_size))
    pieces = document_pieces(docs, length, end_id, tokenizer).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def run(table):
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
        doc, tokens = np.asarray(table["doc_id"]), np.asarray(table["doc_tokens"])
        crcs = table["crcs"].combine_chunks()
        crcs = np.asarray(crcs.flatten())
        n_pieces = -(-tokens // length)
        row = np.repeat(np.arange(len(doc)), n_pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = nth * length
        size = np.minimum(tokens[row] - start, length)
        seq, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        part = size < length
        full = np.flatnonzero(~part)
        seq[full] = np.arange(len(full))
        bins, offset[part] = first_fit_decreasing(size[part], length)
        seq[part] = len(full) + bins
        fill = np.bincount(seq, weights=size).astype(np.int64)[seq]
        whole = (fill & (fill - 1)) == 0
        seq = seq + (int(table["grp"][0].as_py()) << 32)
        cols = [doc[row], start, size, crcs, tokens[row], seq, offset, np.where(whole, fill, length)]
        return pa.table([pa.array(x.astype(np.int64)) for x in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"])

    return pieces.groupBy("grp").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
