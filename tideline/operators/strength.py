"""Strength of memories: the fold of their history in closed form, and what a refresh does with it.

A boost is affine and decay is exponential at a constant rate, so the strength after n accesses is a sum over them:
one window and one aggregation, whatever the number of refreshes between.

Rows of a snapshot go on from it: score at score_at, access_count, last_access, protected and retired stand for all that
was before, and only later events are folded.  So a state is carried forward from what is new, and rows that no event
touches cost nothing but a column expression.

Events with a null id, ts or op, of unknown ids, before a memory is made, after ``now`` or after its retirement count
for nothing.  Repeated ids among memories are the caller's fault and stay rows.  An empty table gives no row.  Other
columns of memories are kept, so long as they don't have the names of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model, text
from ..sources import scratch


def lifecycle(memories: DataFrame, events: DataFrame, now: float) -> DataFrame:
    """Per memory with events up to now: retired_at, pinned (before it was retired, if it was)."""
    e = events.where((F.col("ts") <= now) & F.col("op").isin("retire", "pin")).join(memories.select("id", "created"), "id").where("ts >= created")
    out = e.groupBy("id").agg(F.min(F.when(F.col("op") == "retire", F.col("ts"))).alias("retired_at"), F.min(F.when(F.col("op") == "pin", F.col("ts"))).alias("pinned_at"))
    return out.withColumn("pinned", F.col("pinned_at").isNotNull() & (F.col("retired_at").isNull() | (F.col("pinned_at") < F.col("retired_at"))))


#: What a snapshot says of a row; null for rows that are new.
SNAPSHOT = "score double, score_at double, access_count bigint, used double, protected boolean, gone boolean"


def snapshot(memories: DataFrame) -> list:
    """The columns of SNAPSHOT; all null where memories is no snapshot."""
    return [(F.col(c) if c in memories.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in SNAPSHOT.split(", "))]


def snapshot_of(state: DataFrame, now: float, *columns: str) -> DataFrame:
    """A state folded at now as memories of a snapshot: id, the columns, and those of SNAPSHOT."""
    return state.select("id", *columns, F.col("strength").alias("score"), F.lit(float(now)).alias("score_at"), F.col("n_access").cast("long").alias("access_count"), F.col("last_access").alias("used"), F.col("pinned").alias("protected"), F.col("retired").alias("gone"))


def fold(memories: DataFrame, events: DataFrame, now: float, exact: bool = False) -> DataFrame:
    """memories with n_access, last_access, strength at now (to nine digits unless exact), pinned, retired, tier."""
    own = [c for c in memories.columns if c not in {x.split()[0] for x in SNAPSHOT.split(", ")}]
    m = memories.select(*own, *snapshot(memories)).withColumn("rate", model.rate(F.col("category"))).withColumn("gone", F.coalesce("gone", F.lit(False)))
    life = lifecycle(m, events, now)
    a = events.where("op = 'access'").join(m.where("NOT gone").select("id", "created", "rate"), "id").join(life.select("id", "retired_at"), "id", "left")
    a = a.where((F.col("ts") >= F.col("created")) & (F.col("ts") <= now) & (F.col("retired_at").isNull() | (F.col("ts") < F.col("retired_at"))))
    by = Window.partitionBy("id")
    a = a.withColumn("k", F.row_number().over(by.orderBy("ts", "seq"))).withColumn("n", F.count("*").over(by))
    keep = 1 - model.BOOST
    gain = F.sum(F.pow(F.lit(keep), F.col("n") - F.col("k")) * F.exp(-F.col("rate") * (now - F.col("ts")) / model.DAY)).alias("gain")
    sums = a.groupBy("id").agg(gain, F.count("*").alias("n_access"), F.max("ts").alias("accessed_at"))
    out = m.join(sums, "id", "left").join(life.select("id", "retired_at", F.col("pinned").alias("later")), "id", "left")
    out = out.withColumn("n_access", F.coalesce("n_access", F.lit(0)))
    since = model.days_since(F.coalesce("score_at", "created"), now)
    first = F.coalesce("score", F.lit(model.INITIAL)) * F.pow(F.lit(keep), "n_access") * F.exp(-F.col("rate") * since)
    pinned = F.coalesce("protected", F.lit(False)) | F.coalesce("later", F.lit(False))
    s = F.when(pinned, 1.0).otherwise(first + model.BOOST * F.coalesce("gain", F.lit(0.0)))
    out = out.withColumn("strength", s if exact else F.round(s, 9)).withColumn("pinned", pinned).withColumn("retired", F.col("gone") | F.col("retired_at").isNotNull())
    out = out.withColumn("n_access", F.coalesce("access_count", F.lit(0)) + F.col("n_access")).withColumn("last_access", F.greatest("accessed_at", F.coalesce("used", "created")))
    return out.withColumn("tier", model.tier(F.col("strength"), F.col("pinned"))).select(*own, "n_access", "last_access", "strength", "pinned", "retired", "tier")


def collapsed(memories: DataFrame) -> DataFrame:
    """One row for each identity (trimmed text), as adding them one by one leaves it: the first made survives, the
    number of others is in ``copies``."""
    rows = memories.withColumn("identity", text.identity(F.col("content")))
    first = rows.groupBy("identity").agg(F.min(F.struct("created", "id"))["id"].alias("id"), (F.count("*") - 1).alias("copies"))
    return memories.join(first.drop("identity"), "id")


def merged(state: DataFrame) -> DataFrame:
    """Live duplicates of a text merged into the one made last (by created and id): counts added, the largest strength
    and access, the earliest creation.  Retired rows neither merge nor win, and stay."""
    live = state.where("NOT retired").groupBy(text.identity(F.col("content")).alias("identity")).agg(
        F.max(F.struct("created", "id"))["id"].alias("id"), F.sum("n_access").alias("n_access"), F.max("strength").alias("strength"), F.max("last_access").alias("last_access"), F.min("created").alias("created"), F.bool_or("pinned").alias("pinned")
    )
    rows = live.withColumn("strength", F.when(F.col("pinned"), 1.0).otherwise(F.col("strength"))).withColumn("retired", F.lit(False)).drop("identity")
    return rows.unionByName(state.where("retired").select(*rows.columns))


def pruned(state: DataFrame, most: DataFrame) -> DataFrame:
    """The rows that go so that at most ``most`` stay (one row, one column; 0: no limit): archived and not pinned,
    weakest first, then those last used latest.

    A histogram of strengths in steps of 1e-6 says up to which step all go; only the rows of that step are ranked.
    """
    weak = state.where("tier = 'archived' AND NOT pinned").withColumn("step", F.floor(F.col("strength") * 1e6).cast("long"))
    limit = state.agg(F.count("*").alias("total")).crossJoin(F.broadcast(most.toDF("most")))  # one row
    gone = F.when(F.col("most") > 0, F.greatest(F.lit(0), F.col("total") - F.col("most"))).otherwise(0)
    limit = limit.select(gone.cast("long").alias("gone"))
    steps = weak.groupBy("step").agg(F.count("*").alias("n"))  # at most 100,001 rows
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    steps = steps.crossJoin(F.broadcast(limit)).where("before < gone")
    rows = weak.join(F.broadcast(steps.drop("n")), "step")
    rank = F.row_number().over(Window.partitionBy("step").orderBy("strength", F.col("last_access").desc(), "id"))
    return rows.withColumn("rank", F.col("before") + rank).where("rank <= gone").drop("step", "before", "gone", "rank")


def refresh_report(state: DataFrame, last: float, now: float, most: int = 0) -> DataFrame:
    """decayed, merged, pruned, prune_deficit, total of a refresh of ``state`` (folded at now), the one before being at
    ``last``.

    A row is realised when it is made, used and refreshed, so it decayed by what it lost since the latest of these;
    drops up to 1e-12 don't count.
    """
    since = model.days_since(F.greatest(F.lit(float(last)), F.col("last_access")), now)
    lost = F.col("strength") * (F.exp(model.rate(F.col("category")) * since) - 1)
    live = F.when(~F.col("retired"), text.identity(F.col("content")))
    sums = state.agg(
        F.coalesce(F.sum((~F.col("pinned") & (lost > 1e-12)).cast("long")), F.lit(0)).alias("decayed"),
        (F.count(live) - F.count_distinct(live)).alias("merged"),
        F.count("*").alias("rows"),
    )
    if not most:
        return sums.select("decayed", "merged", F.lit(0).cast("long").alias("pruned"), F.lit(0).cast("long").alias("prune_deficit"), (F.col("rows") - F.col("merged")).alias("total"))
    after = merged(state).withColumn("tier", model.tier(F.col("strength"), F.col("pinned")))
    weak = after.agg(F.coalesce(F.sum((~F.col("pinned") & (F.col("tier") == "archived")).cast("long")), F.lit(0)).alias("weak"))
    both = sums.crossJoin(F.broadcast(weak))  # one row each
    over = F.greatest(F.lit(0), F.col("rows") - F.col("merged") - most)
    out = both.withColumn("pruned", F.least(over, F.col("weak"))).withColumn("total", F.col("rows") - F.col("merged") - F.col("pruned"))
    return out.select("decayed", "merged", "pruned", F.greatest(F.lit(0), F.col("total") - most).cast("long").alias("prune_deficit"), "total")


def ranked(rows: DataFrame, *order, per_slice: int = 1 << 18) -> DataFrame:
    """rows with ``rank`` from 1 in one order over all of them: ranges are sorted and counted apart, and each row's
    place in its range is moved by the rows of the ranges before, so no task sees all rows."""
    slices = max(16, rows.count() // per_slice)
    parts = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = scratch.written(parts, scratch.folder(rows.sparkSession, "ranked"))  # ranges come from a sample: cut once
    counts = parts.groupBy("slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return parts.join(F.broadcast(before), "slice").withColumn("rank", F.col("before") + F.col("place") + 1).drop("slice", "place", "before")
