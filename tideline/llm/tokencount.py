"""Operator 2: token counts by a separator scan of flat, unindexed token files.

A token file is nothing but little-endian ids of one width; each document ends with the end-of-document id.  The scan
cuts files into blocks of fixed size without regard to documents, finds the separators of each block with one
vectorised comparison, and knows of each block: its whole documents' counts, the ids after its last separator, and
whether it has a separator at all.  A prefix scan over the blocks, in order, then stitches the documents that cross
block boundaries: what a block carries in is the sum of the tails since the last block with a separator.

A last document without separator counts, as open.  Empty files and an empty table give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder
from .words import blocks

WIDTHS = {2: "<u2", 4: "<u4"}


def write_flat(docs: DataFrame, folder: str, end_id: int, tokenizer: str | None = None, width: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as flat token files, one a partition. Returns (file, n_bytes, docs): the doc_ids in
    file order, which the files themselves don't hold. Null texts are empty; a null doc_id stays null."""

    def run(batches):
        from pyspark import TaskContext

        task, encode = TaskContext.get(), encoder(tokenizer)
        name = f"tokens-{task.partitionId():06d}.bin"
        keys, total = [], [0]

        def parts():
            for batch in batches:
                keys.append(batch.column(0))
                for b in blocks(batch.column(1), 1 << 21):
                    ids, to = encode.encode(b)
                    if len(ids) and (int(ids.max()) >> (8 * width) or (ids == end_id).any()):
                        raise ValueError("an id of the text is the end id or too large for the file's width")
                    raw = np.insert(ids, to[1:], end_id).astype(WIDTHS[width]).tobytes()
                    total[0] += len(raw)
                    yield raw

        store.write_bytes(f"{folder}/{name}", parts(), f"{task.stageId()}-{task.taskAttemptId()}")
        at = 0
        for k in keys:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(np.arange(at, at + len(k))), k.cast(pa.int64()), pa.array([total[0]] * len(k))], ["file", "nth", "doc_id", "n_bytes"])
            at += len(k)

    return docs.select("doc_id", "text").mapInArrow(run, "file string, nth long, doc_id long, n_bytes long")


def block_counts(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int, int]:
    """(ids up to and with each separator since the one before or the block's start, ids after the last, separators)."""
    at = np.flatnonzero(ids == end_id)
    return np.diff(at, prepend=-1), len(ids) - (int(at[-1]) + 1 if len(at) else 0), len(at)


def separator_scan(files: DataFrame, folder: str, end_id: int, width: int = 2, block_bytes: int = 1 << 20, blocks_a_task: int = 64) -> DataFrame:
    """Per document of the flat files (file, n_bytes): file, nth (from 0), n_tokens with its separator, closed."""
    cut = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.col("n_bytes") - 1).cast("long")), F.lit(block_bytes).cast("long"))).alias("at"))

    def scan(batches):
        for batch in batches:
            names, n_bytes, at = (batch.column(i).to_pylist() for i in range(3))
            for name, n, a in zip(names, n_bytes, at, strict=True):
                fs, path = store.filesystem(f"{folder}/{name}")
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, n - a), a), WIDTHS[width])
                counts, tail, seps = block_counts(ids, end_id)
                yield pa.RecordBatch.from_pydict({"file": [name], "at": [a], "counts": [counts], "tail": [tail], "seps": [seps], "last": [a + block_bytes >= n]}, pa.schema([("file", pa.string()), ("at", pa.int64()), ("counts", pa.list_(pa.int64())), ("tail", pa.int64()), ("seps", pa.int64()), ("last", pa.bool_())]))

    # An explicit number: the planner would put the small table of blocks into one task, which would read all files.
    n_blocks = files.agg(F.sum(F.ceil(F.col("n_bytes") / block_bytes))).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-int(n_blocks) // blocks_a_task))
    scanned = cut.where("n_bytes > 0").repartition(tasks, "file", "at").mapInArrow(scan, "file string, at long, counts array<long>, tail long, seps long, last boolean")
    # The prefix scan, a row a block: documents begun before, and ids carried in since the last separator.
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("file", "breaks").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        scanned.withColumn("nth0", F.coalesce(F.sum("seps").over(before), F.lit(0)))
        .withColumn("breaks", F.coalesce(F.count(F.when(F.col("seps") > 0, 1)).over(before), F.lit(0)))
        .withColumn("carry", F.coalesce(F.sum("tail").over(run), F.lit(0)))
    )
    # In a run of blocks with the same number of breaks before them, the first is the one behind a separator; the tail
    # of the block with that separator belongs to the run as well.
    behind = Window.partitionBy("file").orderBy("at")
    stitched = stitched.withColumn("edge", F.when(F.lag("seps").over(behind) > 0, F.lag("tail").over(behind)))
    stitched = stitched.withColumn("carry", F.col("carry") + F.coalesce(F.last("edge", True).over(Window.partitionBy("file", "breaks").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    # Behind the counts of a block comes its tail, which counts where the file ends with it.
    ends = F.when(F.col("last"), F.concat("counts", F.array("tail"))).otherwise(F.col("counts"))
    out = stitched.select("file", F.posexplode(ends).alias("i", "n"), "nth0", "carry", "seps")
    n = F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(F.lit(0))
    closed = F.col("i") < F.col("seps")
    return out.select("file", (F.col("nth0") + F.col("i")).alias("nth"), n.alias("n_tokens"), closed.alias("closed")).where("closed OR n_tokens > 0")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from flat files that hold only ids: doc_id, n_tokens with the end id."""
    store.light_batches(spark)
    end_id = 50256
    folder = store.scratch(spark, "flat")
    placed = store.written(write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, end_id), store.scratch(spark, "flat-docs"))
    files = placed.select("file", "n_bytes").distinct()
    found = separator_scan(files, folder, end_id)
    # A row a document on both sides: never broadcast.
    return placed.join(found.hint("merge"), ["file", "nth"], "left").select("doc_id", "n_tokens", "file", F.col("nth").alias("position"))
