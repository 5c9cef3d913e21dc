"""Operator 4: near duplicates by banded MinHash, odd sketches and exact confirmation, as connected components.

1. One scan makes a row for each document: a 128-bit fingerprint of its shingle set, one key for each band of MinHash
   values, and two odd sketches.  An odd sketch has a bit for the parity of the number of items that fall on it, so the
   population count of the XOR of two tells how many items differ.  Over MinHash samples it estimates the similarity,
   most precisely where that is high.  Over the whole set it never counts more than the sets differ by, so it bounds
   the similarity from above and drops no pair that belongs.
2. Documents with equal fingerprints are one class; only its smallest doc_id goes on.
3. Each bucket of a band has up to PIVOTS pivots: the members whose buckets are the largest, which are the most central
   ones of a group.  Members are candidates with pivots, so a bucket of m gives at most PIVOTS * m of them.  Those
   that the sketches don't rule out are compared as full sets.
4. Links give components. A bucket whose members are in different components still may hide links between these:
   its pairs across components that the sketches don't rule out are compared in a second round.  So each pair of a
   bucket is ruled out, compared, or already connected, and each is met in the first band it shares only.

A pair at the threshold shares no band with a chance of 2.4e-7 at 0.85 and 3.3e-5 at 0.8 (26 bands of 5).  No step gathers links or documents
on the driver, and no group is held in one task as a whole.

Null texts and texts without words have no shingle and are linked with nothing.  Rows without doc_id are left out.
Rows that repeat a doc_id stay; each distinct set of theirs is compared by itself, and such a row is kept if its component
has no smaller doc_id.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import classes, store
from .words import U, blocks, mix, shingles, word_names

BANDS, ROWS, SKETCH_BITS, SET_BITS, PIVOTS = 26, 5, 512, 1024, 8


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def min_hashes(h: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of each document's sorted distinct shingles; documents without shingles get 0."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    if not len(full):
        return out
    starts = offsets[:-1][full]
    folded = h ^ (h >> U(32))
    for i, a in enumerate(_seeds(n)):
        x = ((folded * a) >> U(32)).astype(np.uint32)
        out[full, i] = np.minimum.reduceat(x, starts)
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band."""
    x = mins[:, : bands * rows].astype(U).reshape(len(mins), bands, rows)
    k = np.broadcast_to(np.arange(1, bands + 1, dtype=U), x.shape[:2])
    for r in range(rows):
        k = mix(k * U(0xD6E8FEB86659FD93) + x[:, :, r])
    return k


def parities(row: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n bitmaps, as uint64 words: bit ``at`` of bitmap ``row`` is flipped, for each of the pairs."""
    odd = np.bincount(row * bits + at, minlength=n * bits).astype(np.uint8).reshape(n, bits) & 1
    return np.packbits(odd, axis=1, bitorder="little").view(U)


def odd_sketches(mins: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches of MinHash samples: each sample, its number and value, flips one bit."""
    n, k = mins.shape
    at = (mix(mins.astype(U) + (np.arange(1, k + 1, dtype=U) << U(32))) % U(bits)).astype(np.int64)
    return parities(np.repeat(np.arange(n), k), at.ravel(), n, bits)


def most_flips(similarity: float, samples: int, bits: int, sigmas: float = 5.0) -> int:
    """The largest XOR count that a pair of this similarity shows, by that many standard deviations of the samples
    that differ and of the bits these flip.

    m flips leave an odd count on bits * (1 - (1 - 2 / bits)**m) / 2 bits.
    """
    differing = samples * (1 - similarity)
    spread = (4 * samples * similarity * (1 - similarity) + 2 * differing * (2 * differing / bits)) ** 0.5
    m = min(2 * samples, 2 * differing + sigmas * spread)
    return int(bits * (1 - (1 - 2 / bits) ** m) / 2) + 1


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint), bands, sketch (of the samples), whole (sketch of the set)."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, to = shingles(*word_names(b), k)
                n = np.diff(to)
                keyed = classes.fingerprints(h, to)
                mins = min_hashes(h, to, BANDS * ROWS)
                bands = band_keys(mins, BANDS, ROWS)
                sketch = odd_sketches(mins, SKETCH_BITS)
                whole = parities(np.repeat(np.arange(b.n), n), (mix(h + U(77)) % U(SET_BITS)).astype(np.int64), b.n, SET_BITS)
                fixed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(n), pa.array(keyed[0].view(np.int64)), pa.array(keyed[1].view(np.int64)), fixed(bands), fixed(sketch), fixed(whole)],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch", "whole"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, whole array<long>")


def _flips(name: str, bits: int) -> str:
    """SQL: population count of the XOR of the sketches of x and y, which are in columns of 64 bits each. (As arrays
    the condition would be too long for the JVM to compile.)"""
    return "(" + " + ".join(f"bit_count(x.{name}{i} ^ y.{name}{i})" for i in range(bits // 64)) + ")"


def _possible(percent: int) -> str:
    """SQL: no sketch rules the pair of members x and y out, and they meet in the first band they share."""
    far = most_flips(percent / 100, BANDS * ROWS, SKETCH_BITS)
    return f"""100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND {100 - percent} * (x.n + y.n) >= {100 + percent} * {_flips("whole", SET_BITS)}
        AND {_flips("sketch", SKETCH_BITS)} <= {far}
        AND NOT arrays_overlap(slice(x.bands, 1, x.band), slice(y.bands, 1, x.band))"""


def components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """(doc_id, component): the smallest doc_id reachable, for every end of a link (a, b), by alternating stars.

    A large star joins each node's larger neighbours to its smallest, a small star joins the smaller ones and the node
    itself; both keep components, and when neither changes a link each node is joined to its component's smallest.
    """
    edges = store.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    seen = None
    for turn in range(1, 60):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("m")), F.struct(F.col("u").alias("x"), F.col("m").alias("m")))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        edges = store.written(small.where("u <> v").distinct(), f"{folder}/{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components have not settled; more turns are needed")
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("doc_id"), "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, class_id (smallest doc_id of
    an equal set), n_copies (rows with an equal set)."""
    spark = docs.sparkSession
    folder = store.scratch(spark, "neardup")
    sig = store.written(signatures(docs, k), f"{folder}/sig")
    reps = classes.of_rows(sig, "n_shingles", ["bands", "sketch", "whole"], folder)
    # Keys alone are dealt out by bucket; sketches follow, by doc_id, for members of buckets of two and more.
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    slim = store.written(keyed.join(buckets, "key"), f"{folder}/slim")
    # Bands differ in all their keys, so 31 bits of them tell which bands two members share; a bucket has all 64.
    words = [F.col(name)[i].alias(f"{name}{i}") for name, bits in (("sketch", SKETCH_BITS), ("whole", SET_BITS)) for i in range(bits // 64)]
    short = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")
    sketches = reps.select("rep", "n", short, *words)
    weight = slim.groupBy("rep").agg(F.sum(F.log2("size")).alias("weight"))
    rank = Window.partitionBy("key").orderBy(F.col("weight").desc(), "rep")
    # The last of a bucket meets all others as they are pivots.
    pivots = slim.select("key", "rep", "size").join(weight, "rep").withColumn("rn", F.row_number().over(rank)).where((F.col("rn") <= PIVOTS) & (F.col("rn") < F.col("size"))).select("key", "rep", F.lit(True).alias("pivot"))
    flagged = slim.select("key", "rep", "band").join(pivots, ["key", "rep"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    members = store.written(flagged.join(sketches, "rep"), f"{folder}/members")
    pairs = members.where("pivot").alias("x").join(members.alias("y"), F.expr(f"x.key = y.key AND x.rep <> y.rep AND (NOT y.pivot OR x.rep < y.rep) AND {_possible(percent)}"))
    ends = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    star = store.written(pairs.select(*ends).distinct(), f"{folder}/star")
    store.remove(spark, f"{folder}/members")  # star is written, nothing goes back to them
    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    links = store.written(classes.confirmed(star, classes.texts(docs, reps, ends_of(star), k, f"{folder}/texts1"), k, percent), f"{folder}/links")
    comp = store.written(components(spark, links, f"{folder}/cc1"), f"{folder}/comp1").withColumnRenamed("doc_id", "rep")
    # Second round: pairs of a bucket across components.
    placed = slim.select("key", "rep", "band").join(comp, "rep", "left").select("key", "rep", "band", F.coalesce("component", "rep").alias("c"))
    # One of a pair across components is outside the bucket's largest component.
    largest = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    placed = store.written(placed.join(largest, "key").join(sketches, "rep"), f"{folder}/placed")
    cross = placed.where("c <> main").alias("x").join(placed.alias("y"), F.expr(f"x.key = y.key AND x.c <> y.c AND (y.c = y.main OR x.rep < y.rep) AND {_possible(percent)}")).select(*ends)
    cross = store.written(cross.join(star, ["a", "b"], "left_anti"), f"{folder}/cross")
    store.remove(spark, f"{folder}/placed")
    more = store.written(classes.confirmed(cross, classes.texts(docs, reps, ends_of(cross), k, f"{folder}/texts2"), k, percent), f"{folder}/more")
    if more.take(1):
        comp = store.written(components(spark, comp.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(more), f"{folder}/cc2"), f"{folder}/comp2").withColumnRenamed("doc_id", "rep")
    out = classes.to_rows(sig, "n_shingles", reps, comp, folder)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"), "class_id", "n_copies")


def op4_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
