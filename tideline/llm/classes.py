"""Classes of documents with equal shingle sets: their names, texts, exact comparison, and the way back to rows.

A class is known by a 128-bit fingerprint (f1, f2) of its set and led by its smallest doc_id.  Its name (rep) is that
doc_id; where rows of one doc_id have several sets, and so lead several classes, a hash of doc_id and fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import U, blocks, mix, shingles, word_names

#: A class with this share of all rows, or more, counts as large; so there are at most as many.
LARGE = 1000
#: Words of 64 bits in the bitmap of document hashes that goes to every executor.
MAP_WORDS = 1 << 17


def fingerprints(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of mixed shingles for each document; 0 for documents without shingles."""
    out = np.zeros((2, len(to) - 1), U)
    full = np.flatnonzero(np.diff(to))
    if len(full):
        out[0, full] = np.add.reduceat(mix(h), to[:-1][full])
        out[1, full] = np.add.reduceat(mix(h ^ U(0xA5A5A5A5DEADBEEF)), to[:-1][full])
    return out


def of_rows(rows: DataFrame, size: str, columns: list[str], folder: str) -> DataFrame:
    """rep, doc_id, members, f1, f2, n and the columns of each class, written. rows: doc_id, f1, f2, size, columns."""
    least = F.min(F.struct("doc_id", F.col(size).alias("n"), *columns)).alias("s")
    found = rows.where(F.col(size) > 0).groupBy("f1", "f2").agg(least, F.count("*").alias("members")).select("f1", "f2", "members", "s.*")
    found = store.written(found, f"{folder}/classes")
    several = store.written(found.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1"), f"{folder}/several")
    if not several.take(1):
        return found.withColumn("rep", F.col("doc_id"))
    name = F.when(F.col("sets").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "f1", "f2"))
    return store.written(found.join(several, "doc_id", "left").withColumn("rep", name).drop("sets"), f"{folder}/named")


def texts(docs: DataFrame, reps: DataFrame, some: DataFrame, k: int, path: str) -> DataFrame:
    """rep, text of the classes named in some (rep), written.

    Texts off a bitmap of the classes' doc_ids are left out first, so that few texts are dealt out where the classes are
    too many to broadcast.  The bitmap has at most MAP_WORDS rows at any size; the more ids, the more texts pass it.  Of
    a doc_id with several sets, the text whose fingerprint is the class's is taken.
    """
    named = store.written(reps.select("rep", "doc_id", "f1", "f2").join(some, "rep"), f"{path}-ends")
    word, bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_WORDS)), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 1), 64) AS int))")
    bitmap = store.written(named.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), f"{path}-bitmap")
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    near = rows.join(F.broadcast(bitmap), (word == bitmap["word"]) & (bit.bitwiseAND(bitmap["bits"]) != 0), "left_semi")
    met = near.join(named, "doc_id").select("rep", "text", "f1", "f2", F.col("rep") == F.col("doc_id"))

    def own(batches):
        """Rows whose text has the class's set."""
        for batch in batches:
            for b in blocks(batch.column(1)):
                part = batch.slice(b.first, b.n)
                key = fingerprints(*shingles(*word_names(b), k)).view(np.int64)
                same = (key[0] == part.column(2).to_numpy()) & (key[1] == part.column(3).to_numpy())
                yield part.select(["rep", "text"]).filter(pa.array(same))

    return store.written(met.mapInArrow(own, "rep long, text string").dropDuplicates(["rep"]), path)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose whole shingle sets have 100 * both >= percent * either."""
    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 64):  # few texts at once
                part = batch.slice(lo, 64)
                sides = []
                for t in (part.column(2), part.column(3)):
                    made = [shingles(*word_names(b), k) for b in blocks(t)]
                    sides.append([h[x:y] for h, to in made for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)])
                keep = []
                for i, (x, y) in enumerate(zip(*sides, strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column(j).take(pa.array(keep)) for j in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def to_rows(rows: DataFrame, size: str, reps: DataFrame, comp: DataFrame, folder: str) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of the component), class_id, n_copies (rows of the
    class).  comp: rep, component.

    Rows without shingles are their own class.  Rows of large classes, of which there are at most LARGE, meet these by
    broadcast, so none waits for its class in one task.
    """
    ids = reps.select("f1", "f2", "members", "rep", "doc_id").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = store.written(ids.join(first, "component").select("f1", "f2", "members", "component_id", F.col("doc_id").alias("class_id")), f"{folder}/classes-named")
    bare = rows.select("doc_id", F.col(size).alias("n_shingles"), "f1", "f2")
    least = max(2, -(-(named.agg(F.sum("members")).first()[0] or 0) // LARGE))
    columns = ["doc_id", "n_shingles", "component_id", "class_id", F.col("members").alias("n_copies")]
    out = bare.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    met = bare.where("n_shingles > 0").join(F.broadcast(named.where(F.col("members") >= least)), ["f1", "f2"], "left")
    out = out.unionByName(met.where("members IS NOT NULL").select(*columns))
    rest = met.where("members IS NULL").select("doc_id", "n_shingles", "f1", "f2")
    return out.unionByName(rest.join(named.where(F.col("members") < least), ["f1", "f2"]).select(*columns))
