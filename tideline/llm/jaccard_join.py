"""Operator 11: the Jaccard join of shingle sets, by prefixes of token combinations.

The tokens of a set are its shingles.  All sets follow one order of the tokens, rarest first.  If two sets of n and
more tokens are linked, at most ``spare`` = n - ceil(percent * n / 100) tokens of the smaller lack in the other.

1. One scan makes a row for each document: a 128-bit fingerprint of its set, an odd sketch of it (as in the near-duplicate
   operator), and its first tokens.  Tokens whose hash is in the lowest part of its range are *low* ones; all of them
   are kept, and where they are few, the next ones by hash.  So what is kept starts each set's order, and all that is
   sent on is about twice the share that may differ.
2. Documents with equal fingerprints are one class; only its smallest doc_id goes on.
3. Low tokens are counted over all classes, exactly.  A token of one class alone comes first in the order and can't be
   shared; a set with more than ``spare`` of them is linked with nothing and ends here.
4. Tokens are in classes by frequency: RARE and below are indexed one by one (k = 1), FREQUENT and below as pairs
   (k = 2), others as triples (k = 3).  Frequent tokens are dealt into groups by hash, the more the longer the sets, and
   combinations are taken within a group.  If linked sets shared no combination of their prefixes, each group would
   hold k - 1 shared tokens at most; so a prefix is extended until the tokens above that number, over all groups,
   are more than ``spare``.  Sets of one length level use the same groups; a set near a level's edge emits for both.
5. Sets that share a combination are candidates, unless sizes or odd sketches rule the pair out.  Each bucket has a most
   central set (whose buckets are the largest); of these each set is compared with the PIVOTS most central ones in full.
   Links give components; then pairs that lie in different components are compared.  Where a sample says that they are
   more than the classes, this goes in rounds: of buckets with many sets outside their largest component first those
   within parts of bounded size, dealt out anew each round as long as that links much, so a group of linked sets falls
   into one component by few pairs a set; in the last round all that are left.  So each pair of a bucket is ruled out, compared, or already connected: no link between components is lost,
   and no group is expanded into all its pairs.

Result per row with doc_id: doc_id, n_shingles, component_id (smallest doc_id reachable), class_id (smallest doc_id of an
equal set), n_copies (rows with an equal set, itself included).  Null texts and texts without words have no shingle and are
linked with nothing: both ids are their own, n_copies is 1.  Rows that repeat a doc_id stay; each distinct set of
theirs is compared by itself.  Rows without doc_id are left out.  An empty table gives no row.  Other columns are
ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classes, store
from .neardup import components, parities
from .words import STEP, U, blocks, mix, shingles, word_names

RARE, FREQUENT, SET_BITS = 32, 1024, 1024
#: Keys of a set that travel with its rows of the second round: of pairs that share many, one of the first is shared.
FIRST_KEYS = 16
#: Central sets that a set is compared with first.
PIVOTS = 2
#: Sets of a part of a large bucket in the first round, and rounds in which parts, twice as large each time, are compared.
PART, ROUNDS = 64, 5


def spare(n, percent: int):
    """Most tokens of a set of n that may lack in a linked set of n or more."""
    return n - (-(-percent * n // 100))


def level(n: int) -> int:
    return int(n).bit_length()


def groups(lev: int, percent: int) -> int:
    """Groups of frequent tokens for sets of this level: about four tokens of a prefix each."""
    return max(1, (spare(1 << (lev - 1), percent) + 1) // 4)


def low_limit(percent: int) -> int:
    """Hashes below are low: twice the share of tokens that may differ."""
    return min((1 << 64) - 1, 2 * (100 - percent) * (1 << 64) // 100)


def kind_of(df: np.ndarray) -> np.ndarray:
    """Tokens to a combination, by the number of classes that a token is in."""
    return 1 + (df > RARE) + (df > FREQUENT)


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint), low and high (kept tokens by hash), whole (odd sketch)."""
    limit = U(low_limit(percent))

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, to = shingles(*word_names(b), k)
                n = np.diff(to)
                keyed = classes.fingerprints(h, to)
                whole = parities(np.repeat(np.arange(b.n), n), (mix(h + U(77)) % U(SET_BITS)).astype(np.int64), b.n, SET_BITS)
                doc = np.repeat(np.arange(b.n), n)
                low = np.bincount(doc[h < limit], minlength=b.n)  # sorted by hash, so the low ones come first
                high = np.clip(2 * (spare(n, percent) + 1) + 8, low, np.maximum(n, low)) - low
                high = np.minimum(high, n - low)

                def lists(start, size, h=h):
                    at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
                    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[at].view(np.int64)))

                words = SET_BITS // 64
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(n), pa.array(keyed[0].view(np.int64)), pa.array(keyed[1].view(np.int64)), lists(to[:-1], low), lists(to[:-1] + low, high),
                     pa.ListArray.from_arrays(pa.array(np.arange(b.n + 1, dtype=np.int32) * words), pa.array(np.ascontiguousarray(whole).view(np.int64).ravel()))],
                    ["doc_id", "n", "f1", "f2", "low", "high", "whole"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, low array<long>, high array<long>, whole array<long>")


def prefix_keys(n: int, alone: int, low: list[int], df: list[int], high: list[int], percent: int) -> list[int]:
    """Keys of the combinations of a set's prefix. alone: low tokens of no other class; low and df: its other low
    tokens (as signed 64-bit hashes) and their frequencies; high: its kept high tokens by hash."""
    need = spare(n, percent) + 1 - alone
    if need <= 0:
        return []
    low_, df_ = np.array(low, np.int64).view(U), np.array(df, np.int64)
    order = np.lexsort((low_, df_))
    tokens = np.concatenate([low_[order], np.array(high, np.int64).view(U)])
    kinds = np.concatenate([kind_of(df_[order]), np.ones(len(high), np.int64)])
    smallest, largest = -(-percent * n // 100), 100 * n // percent
    out: list[int] = []
    for lev in sorted({level(smallest), level(n), level(largest)}):
        g = groups(lev, percent)
        group = np.where(kinds == 1, np.arange(len(tokens)) + 3 * g, (mix(tokens + U(lev)) % U(g)).astype(np.int64) + g * (kinds - 2))
        by = np.argsort(group, kind="stable")
        first = np.ones(len(by), bool)
        first[1:] = group[by][1:] != group[by][:-1]
        start = np.flatnonzero(first)
        nth = np.empty(len(by), np.int64)  # how many tokens of its group come before a token
        nth[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        counts = np.cumsum(nth >= kinds - 1)
        end = int(np.searchsorted(counts, need)) + 1
        if end > len(tokens):
            raise AssertionError("a prefix is too short")  # what is kept suffices, see sets()
        seed = U(mix(np.array([lev], U))[0])
        one = np.flatnonzero(kinds[:end] == 1)
        out += mix(tokens[one] ^ seed).view(np.int64).tolist()
        members: dict[int, list[int]] = {}
        for i in np.flatnonzero(kinds[:end] > 1).tolist():
            members.setdefault(int(group[i]), []).append(i)
        for at in members.values():
            kind = int(kinds[at[0]])
            if len(at) >= kind:
                chosen = np.sort(tokens[np.array(list(combinations(at, kind)))], axis=1)
                x = chosen[:, 0] ^ seed
                for c in range(1, kind):
                    x = mix(x * U(STEP) + chosen[:, c])
                out += mix(x ^ U(kind)).view(np.int64).tolist()
    return out


def keyed(reps: DataFrame, folder: str, percent: int) -> DataFrame:
    """key, rep: the combinations of all prefixes that may meet others."""
    low = reps.select("rep", F.explode("low").alias("token"))
    shared = store.written(low.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), f"{folder}/shared")
    hits = low.join(shared, "token").groupBy("rep").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"))
    sized = reps.select("rep", "n", F.size("low").alias("kept"), "high")
    least = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    alone = F.col("kept") - F.coalesce(F.size("tokens"), F.lit(0))
    # Sets of high tokens alone are not in hits.
    some = sized.join(hits, "rep", "left").withColumn("alone", alone).where(F.col("alone") < least).select("rep", "n", "alone", "tokens", "df", "high")

    def run(batches):
        for batch in batches:
            rows = (c.to_pylist() for c in batch.columns)
            reps_, keys = [], []
            for rep, n, alone, tokens, df, high in zip(*rows, strict=True):
                made = prefix_keys(n, alone, tokens or [], df or [], high, percent)
                keys += made
                reps_ += [rep] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reps_, pa.int64())], ["key", "rep"])

    return some.mapInArrow(run, "key long, rep long").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, class_id, n_copies."""
    if not 80 <= percent <= 100:
        raise ValueError("combinations of three tokens need a similarity of 80 per cent or more")
    spark = docs.sparkSession
    folder = store.scratch(spark, "jaccard")
    rows = store.written(sets(docs, k, percent), f"{folder}/sets")
    reps = classes.of_rows(rows, "n", ["low", "high", "whole"], folder)
    # A set links with another only if one more or less token keeps it within the limit.
    wide = reps.where(F.col("n") * (100 - percent) >= percent) if percent < 100 else reps.limit(0)
    slim = store.written(keyed(wide, folder, percent), f"{folder}/keys")
    sizes = slim.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    slim = store.written(slim.join(sizes, "key"), f"{folder}/slim")
    weight = slim.groupBy("rep").agg(F.sum(F.log2("size")).alias("w"))
    central = slim.join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", "rep")).alias("pivot"))
    words = [F.col("whole")[i].alias(f"w{i}") for i in range(SET_BITS // 64)]
    sketches = reps.select("rep", "n", *words)
    flips = " + ".join(f"bit_count(x.w{i} ^ y.w{i})" for i in range(SET_BITS // 64))
    possible = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 - percent} * (x.n + y.n) >= {100 + percent} * ({flips})"

    def allowed(pairs: DataFrame) -> DataFrame:
        """pairs (p, q) that sizes and sketches allow."""
        x, y = (sketches.select(F.col("rep").alias(c), F.struct(*sketches.columns).alias(t)) for c, t in (("p", "x"), ("q", "y")))
        return pairs.join(x, "p").join(y, "q").where(possible)

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Of the candidates (p, q), distinct and allowed by sketches, those linked."""
        near = store.written(pairs.select(F.col("p").alias("a"), F.col("q").alias("b")), f"{folder}/{name}-pairs")
        some = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        texts = classes.texts(docs, reps, some, k, f"{folder}/{name}-texts")
        return store.written(classes.confirmed(near, texts, k, percent), f"{folder}/{name}-links")

    ordered = lambda x, y: (F.least(x, y).alias("p"), F.greatest(x, y).alias("q"))
    others = store.written(slim.join(central, "key").where("rep <> pivot.rep"), f"{folder}/others")
    star = store.written(others.select(F.col("rep").alias("p"), F.col("pivot.rep").alias("q"), "pivot.w").distinct(), f"{folder}/star")
    near = store.written(allowed(star).select("p", "q", "w"), f"{folder}/near")
    best = near.groupBy("p").agg(F.slice(F.sort_array(F.collect_list(F.struct("w", "q")), asc=False), 1, PIVOTS).alias("best"))
    first = best.select("p", F.explode("best").alias("x")).select(*ordered("p", "x.q")).distinct()
    first = store.written(first, f"{folder}/first")
    links = compared(first, "first")
    comp = store.written(components(spark, links, f"{folder}/cc1"), f"{folder}/comp1").withColumnRenamed("doc_id", "rep")
    # Buckets of two whose pair is ruled out or has been compared are left out.  A pair meets in the first bucket that it
    # shares, or in few: each member has the first of its keys before this one.
    missed = near.select(*ordered("p", "q")).distinct().join(first, ["p", "q"], "left_anti")
    two = others.where("size = 2").select("key", *ordered("rep", "pivot.rep")).join(missed, ["p", "q"], "left_semi").select("key")
    open_ = slim.where("size > 2").unionByName(slim.where("size = 2").join(two, "key", "left_semi"))
    open_ = store.written(open_.select("key", "rep", "size"), f"{folder}/open")
    own = open_.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_KEYS).alias("own"))
    before = F.filter("own", lambda k: k < F.col("key"))

    def across(comp: DataFrame, name: str, r: int | None = None) -> DataFrame:
        """Candidates of different components, written, with one outside the bucket's largest component; in round r those
        that lie in one part of a bucket, for large buckets with many sets outside that component."""
        most = PART << (r or 0)
        # Parts are a power of two, so that a pair meets in one part of all its buckets of about a size.
        part = F.lit(0) if r is None else F.pmod(F.xxhash64("rep", F.lit(r)), F.pow(F.lit(2.0), F.ceil(F.log2("size")) - math.log2(most)).cast("long"))
        placed = open_.join(comp, "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("c"))
        placed = placed.where(F.col("size") > 2 * most) if r is not None else placed
        main = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("kinds"), (F.sum("m") - F.max("m")).alias("outside"))
        main = main.where("kinds > 1" if r is None else F.col("outside") > most).select("key", "main")
        placed = placed.join(main, "key").withColumn("part", part)
        placed = store.written(placed.join(own.join(sketches, "rep"), "rep").withColumn("before", before).drop("own"), f"{folder}/{name}-placed")
        met = f"x.key = y.key AND x.part = y.part AND x.c <> y.c AND (y.c = y.main OR x.rep < y.rep) AND {possible} AND NOT arrays_overlap(x.before, y.before)"
        pairs = placed.where("c <> main").alias("x").join(placed.alias("y"), F.expr(met)).select(F.least("x.rep", "y.rep").alias("p"), F.greatest("x.rep", "y.rep").alias("q")).distinct()
        pairs = store.written(pairs.join(first, ["p", "q"], "left_anti"), f"{folder}/{name}")
        store.remove(spark, f"{folder}/{name}-placed")  # pairs are written, nothing goes back to it
        return pairs

    def joined(comp: DataFrame, more: DataFrame, name: str) -> DataFrame:
        """comp with the links more, by components of its components; the smallest set of one is not in comp."""
        ends = [comp.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
        met = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        roots = store.written(components(spark, met, f"{folder}/{name}-cc"), f"{folder}/{name}-roots").select("doc_id", F.col("component").alias("root"))
        old = comp.join(roots, F.col("component") == F.col("doc_id"), "left").select("rep", F.coalesce("root", "component").alias("component"))
        return store.written(old.unionByName(roots.select(F.col("doc_id").alias("rep"), F.col("root").alias("component"))), f"{folder}/{name}-comp")

    # Parts grow as the sets that no link has met get fewer.
    largest, total = open_.agg(F.max("size")).first()[0] or 0, wide.count()
    for r in range(ROUNDS if largest > 2 * PART else 0):
        pairs = across(comp, f"parts{r}", r)
        asked = pairs.count()
        if asked * largest <= total * (PART << r):  # a part is this share of a bucket, so all pairs are no more than classes
            break
        more = compared(pairs, f"parts{r}")
        linked = more.count()
        if linked:
            comp = joined(comp, more, f"parts{r}")
        if 4 * linked <= asked:  # few of the rest are linked, so parts would not spare the last round much
            break
    # Then all pairs that still lie across components.
    cross = across(comp, "cross")
    if cross.take(1):
        more = compared(cross, "cross")
        if more.take(1):
            comp = joined(comp, more, "cross")
    return classes.to_rows(rows, "n", reps, comp, folder)


def op11_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
