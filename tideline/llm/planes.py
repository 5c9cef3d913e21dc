"""Operator 10: token ids in a binary file whose fixed-size blocks are transposed into bit or byte planes.

Layout of a file: magic ``TLP1``; the compressed planes, chunk by chunk; the index as Parquet-free binary arrays; a
footer.  A chunk holds ``block`` ids (the last one fewer) as unsigned 32-bit numbers, transposed into 4 byte planes or
32 bit planes.  Each plane is compressed with zstandard by itself, so the planes of high bits, nearly all zero, shrink
to a few bytes.  The index has each plane's position and size and each document's id and number of ids, so any
document can be read by opening only the chunks it lies in.

Null texts are empty and have the end id alone.  Rows without doc_id have no place in the order and are left out.
Rows that repeat a doc_id stay, next to each other.  An empty table gives no file and no row.  Other columns are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder
from .words import blocks

MAGIC = b"TLP1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of uint32 ids: 4 of bytes, or 32 of bits (bit i of each id, packed in order)."""
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [parts[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(parts, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """What to_planes took."""
    rows = [np.frombuffer(x, np.uint8) for x in planes]
    if kind == "byte":
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(x, count=n, bitorder="little") for x in rows], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Collects ids and yields the bytes of one file; holds one block of ids and the index."""

    def __init__(self, kind: str = "byte", block: int = BLOCK, level: int = 1):
        import zstandard

        if kind not in ("byte", "bit"):
            raise ValueError("planes are of kind byte or bit")
        self.kind, self.block, self.zip = kind, block, zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.at, self.n = 0, len(MAGIC), 0
        self.sizes: list[int] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _chunk(self, ids: np.ndarray) -> bytes:
        out = [self.zip.compress(x) for x in to_planes(ids, self.kind)]
        self.sizes += map(len, out)
        self.n += len(ids)
        return b"".join(out)

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append(docs)
        self.counts.append(counts)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            x = np.concatenate(self.waiting)
            whole = len(x) // self.block * self.block
            self.waiting, self.n_waiting = [x[whole:]], len(x) - whole
            for i in range(0, whole, self.block):
                yield self._chunk(x[i : i + self.block])

    def end(self) -> Iterator[bytes]:
        if self.n_waiting:
            yield self._chunk(np.concatenate(self.waiting))
        empty = [np.zeros(0, np.int64)]
        index = [np.array(self.sizes, "<u4").tobytes(), np.concatenate(self.docs or empty).astype("<i8").tobytes(), np.concatenate(self.counts or empty).astype("<u4").tobytes()]
        head = json.dumps({"kind": self.kind, "block": self.block, "ids": self.n, "parts": [len(x) for x in index]}).encode()
        yield b"".join(index) + head + len(head).to_bytes(4, "little") + MAGIC


class Reader:
    """Reads a file of Writer through any seekable stream; chunks are opened as they are asked for."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 8)
        tail = stream.read(8)
        if tail[4:] != MAGIC:
            raise ValueError("not a plane file")
        n = int.from_bytes(tail[:4], "little")
        stream.seek(size - 8 - n)
        self.head = json.loads(stream.read(n))
        parts = self.head["parts"]
        stream.seek(size - 8 - n - sum(parts))
        raw = stream.read(sum(parts))
        self.kind, self.block, self.n = self.head["kind"], self.head["block"], self.head["ids"]
        self.planes = 4 if self.kind == "byte" else 32
        self.sizes = np.frombuffer(raw[: parts[0]], "<u4").reshape(-1, self.planes)
        self.docs = np.frombuffer(raw[parts[0] : parts[0] + parts[1]], "<i8")
        self.counts = np.frombuffer(raw[parts[0] + parts[1] :], "<u4").astype(np.int64)
        self.starts = len(MAGIC) + np.cumsum(self.sizes.sum(axis=1, dtype=np.int64)) - self.sizes.sum(axis=1, dtype=np.int64)

    def chunk(self, i: int) -> np.ndarray:
        self.stream.seek(int(self.starts[i]))
        raw = self.stream.read(int(self.sizes[i].sum()))
        to = np.cumsum(self.sizes[i]).tolist()
        n = min(self.block, self.n - i * self.block)
        return from_planes([self.unzip.decompress(raw[a:b]) for a, b in zip([0, *to], to, strict=False)], n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids[start : start + n] of the file."""
        some = [self.chunk(i) for i in range(start // self.block, -(-(start + n) // self.block))] if n else []
        x = np.concatenate(some) if some else np.zeros(0, np.uint32)
        return x[start % self.block :][:n] if n else x

    def all_docs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in order, with few chunks in memory at once."""
        left, chunk = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.docs.tolist(), self.counts.tolist(), strict=True):
            if len(left) < n:
                more, have = [left], len(left)
                while have < n:
                    more.append(self.chunk(chunk))
                    have += len(more[-1])
                    chunk += 1
                left = np.concatenate(more)
            yield doc, left[:n]
            left = left[n:]


def write_planes(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, kind: str = "byte", block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) to plane files in ascending doc_id order; return the manifest (file, n_docs, n_ids).

    Files are named by their place in the order.  Each is written whole or not at all, and a retried task writes the
    same bytes again.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    rows = (rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        task, writer, encode = TaskContext.get(), Writer(kind, block), encoder(tokenizer)
        total = [0, 0]

        def parts():
            yield MAGIC
            for batch in batches:
                keys = np.asarray(batch.column(0))
                for b in blocks(batch.column(1), 1 << 21):
                    ids, to = encode.encode(b)
                    counts = np.diff(to) + 1
                    out = np.insert(ids, to[1:], end_id)
                    total[0] += b.n
                    total[1] += len(out)
                    yield from writer.add(keys[b.first : b.first + b.n], counts, out)
            yield from writer.end()

        whole = parts()
        first = [next(whole), next(whole)]  # no file for no rows
        if total[0]:
            from itertools import chain

            name = f"part-{task.partitionId():06d}.planes"
            store.write_bytes(f"{folder}/{name}", chain(first, whole), f"{task.stageId()}-{task.taskAttemptId()}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [total[0]], "n_ids": [total[1]]}, pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return rows.mapInArrow(run, "file string, n_docs long, n_ids long")


def read_planes(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files of a manifest: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    # One row a file: the running total over it is small at any size.
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = store.filesystem(f"{folder}/{name}")
                with files.open_input_file(path) as stream:
                    r = Reader(stream, stream.size())
                    crc = [zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in r.all_docs()]
                    start = before + np.cumsum(r.counts) - r.counts
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs), pa.array(start), pa.array(r.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task a file; without a number the planner would put the small manifest into one task.
    files = placed.select("file", "before")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.scratch(spark, "planes")
    manifest = store.written(write_planes(docs, folder), store.scratch(spark, "planes-manifest"))
    return read_planes(manifest, folder)
