"""Rankings: windows by query with complete orders, so ties never depend on partitions.

Null strengths sort last; rows without id are the caller's fault.  An empty store gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model
from . import strength

#: Rows of (id, strength, ...) that go to every executor at once; more are met by a shuffled join.
MOST_BROADCAST = 1 << 20
#: Ranked rows that go to every executor to fetch what else their rows of the state have.
MOST_FETCHED = 1 << 18


def fetched(ranked: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """ranked (at most ``most`` rows) with the columns of their rows, which are not dealt out for a few."""
    return (F.broadcast(ranked) if most <= MOST_FETCHED else ranked).join(rows, "id")


def top(scores: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query; Spark cuts each partition to k before the shuffle.  0: all rows."""
    w = Window.partitionBy("qid").orderBy(*(order or (F.col("sim").desc(), "id")))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def placed(sims: DataFrame, state: DataFrame, *columns: str) -> DataFrame:
    """sims with columns of their rows' state."""
    slim = state.select("id", *columns)
    return sims.join(F.broadcast(slim) if slim.count() <= MOST_BROADCAST else slim.hint("shuffle_hash"), "id")


def candidates(sims: DataFrame, state: DataFrame, queries: DataFrame, prior: float = 0.0, pool: int = model.POOL) -> DataFrame:
    """(qid, id, rank, utility, sim, and the state's columns): for every query the live rows by pins, blended score,
    strength and id; rows without a similarity have 0.

    A row without one can only be among the first ``pool`` of a query if it is among the first ``pool`` by pins,
    strength and id, since a similarity never lowers a score; so each query meets that many rows besides its matches, at
    any size of the store.  Matches are cut to ``pool`` before these join them: a match that is cut, and so what stands
    for it at 0, has ``pool`` better ones.
    """
    live = state.where("NOT retired")
    slim = live.select("id", "pinned", "strength")
    head = slim.orderBy(F.col("pinned").desc(), F.col("strength").desc(), "id")
    head = head.limit(pool) if pool else head
    n = queries.select("qid").distinct()
    asked = n.count()
    rest = head.crossJoin(F.broadcast(n) if asked <= MOST_BROADCAST else n).withColumn("sim", F.lit(0.0))
    value = F.round(F.col("sim") + prior * F.col("strength"), 9)
    order = (F.col("pinned").desc(), value.desc(), F.col("strength").desc(), "id")
    rows = placed(sims, slim, "pinned", "strength")
    rows = top(rows, pool, *order).drop("rank") if pool else rows
    rows = rows.unionByName(rest.select(rows.columns)).repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")
    twin = F.row_number().over(Window.partitionBy("qid", "id").orderBy(F.col("sim").desc()))
    rows = rows.withColumn("twin", twin).where("twin = 1").drop("twin")
    rows = rows.withColumn("utility", value + F.when(F.col("pinned"), model.PINNED_PRIOR).otherwise(0.0))
    ranked = top(rows, pool, *order).drop("pinned", "strength")
    return fetched(ranked, live, asked * pool) if pool else ranked.join(live, "id")


def blind_order() -> tuple:
    return F.col("pinned").desc(), F.col("strength").desc(), F.col("last_access").desc(), F.col("created").desc(), "id"


def query_blind(state: DataFrame, pool: int = model.POOL) -> DataFrame:
    """Live rows by pins, strength, last access, creation and id: the first ``pool``, which one task may hold; 0: all,
    ranked in slices."""
    live = state.where("NOT retired")
    if not pool:
        return strength.ranked(live, *blind_order())
    first = live.orderBy(*blind_order()).limit(pool)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*blind_order())))
