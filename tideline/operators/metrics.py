"""Retrieval metrics of records (arm, qid, used, ranked, evidence, stale, chars, budget, ...), by record and by group.

Null lists count as empty.  Records without evidence are in no mean of hits and ranks, records without stale ids in no
mean of leaks; means of nothing are 0.0.  An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit(used: Column, evidence: Column) -> Column:
    return F.arrays_overlap(used, evidence).cast("double")


def reciprocal_rank(ids: Column, evidence: Column) -> Column:
    at = F.array_min(F.filter(F.transform(evidence, lambda e: F.array_position(ids, e)), lambda p: p > 0))
    return F.coalesce(1.0 / at, F.lit(0.0))


def precision(used: Column, evidence: Column) -> Column:
    return F.when(F.size(used) > 0, F.size(F.filter(used, lambda x: F.array_contains(evidence, x))) / F.size(used))


def ndcg(ranked: Column, evidence: Column, k: int = 10) -> Column:
    log2 = lambda i: F.log2(i + 2.0)
    gain = F.aggregate(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(evidence, x), 1.0 / log2(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.size(evidence), F.lit(k)) - 1), F.lit(0.0), lambda s, i: s + 1.0 / log2(i))
    return F.when(F.size(evidence) > 0, gain / ideal)


def stale_leak(used: Column, stale: Column) -> Column:
    return F.when(F.size(stale) > 0, F.size(F.array_intersect(stale, used)) / F.size(stale))


#: What a record may have besides; missing columns take these values.
DEFAULTS = {"stale": "array()", "kind": "'unknown'", "source": "'unknown'", "cold": "false", "latency_ms": "0.0D", "judge_state": "'judged'", "judge_score": "0.0D"}


def per_record(records: DataFrame) -> DataFrame:
    """Each record's metrics; null where one has no meaning."""
    for c, v in DEFAULTS.items():
        if c not in records.columns:
            records = records.withColumn(c, F.expr(v) if c != "stale" else F.array().cast("array<string>"))
    u, r, e, s = (F.coalesce(c, F.array().cast("array<string>")) for c in ("used", "ranked", "evidence", "stale"))
    has = F.size(e) > 0
    scored = lambda x: F.round(F.when(has, x), 9)
    return records.select(
        "arm", "qid", "chars", "budget", scored(hit(u, e)).alias("hit"), scored(reciprocal_rank(r, e)).alias("mrr"), scored(precision(u, e)).alias("precision"), scored(ndcg(r, e)).alias("ndcg10"),
        scored(reciprocal_rank(u, e)).alias("mrr_packed"), scored(ndcg(u, e)).alias("ndcg10_packed"), F.round(stale_leak(u, s), 9).alias("stale_leak"), "kind", "source", "cold", "latency_ms", "judge_state", "judge_score",
    )


def outputs() -> list[Column]:
    """The aggregates of summary()."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(name)
    count = lambda c, name: F.count(F.when(c, 1)).cast("double").alias(name)
    judged, warm = F.col("judge_state") == "judged", ~F.col("cold")
    late = F.when(warm, F.col("latency_ms"))
    rate = F.avg("hit")
    return [
        F.count("*").cast("double").alias("queries"), count(F.col("hit").isNotNull(), "scored_queries"), count(judged, "judged_queries"),
        count(F.col("judge_state") == "skipped", "judge_skipped"), count(F.col("judge_state") == "errored", "judge_errors"),
        mean(F.when(judged, F.col("judge_score")), "task_success"), mean("hit", "hit_rate"), mean("mrr", "mrr"), mean("ndcg10", "ndcg10"), mean("mrr_packed", "mrr_packed"), mean("ndcg10_packed", "ndcg10_packed"),
        mean("precision", "evidence_precision"), mean("stale_leak", "stale_leak_rate"), mean("chars", "mean_chars"), mean(F.col("chars") / F.col("budget"), "budget_utilisation"),
        mean(late, "mean_latency_ms"), *[F.coalesce(F.percentile(late, q), F.lit(0.0)).alias(f"p{round(100 * q)}_latency_ms") for q in (0.5, 0.95, 0.99)],
        mean(F.when(F.col("cold"), F.col("latency_ms")), "cold_ms"), count(warm, "warm_samples"),
        F.when(rate > 0, F.round(F.avg("chars") / rate, 6)).otherwise(F.lit(float("inf"))).alias("chars_per_hit"),
    ]


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """The 22 outputs by group."""
    return scored.groupBy(*by).agg(*outputs())


def summary_by(scored: DataFrame, *fields: str) -> DataFrame:
    """The 22 outputs of each arm as a whole and by each of the fields, in one pass: (arm, field, value, ...)."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("field"), F.lit("all").alias("value")), *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return scored.withColumn("g", sets).select("*", "g.field", "g.value").groupBy("arm", "field", "value").agg(*outputs())


def cold_first(records: DataFrame) -> DataFrame:
    """records with ``cold``: the first of its arm and scenario, by session and qid."""
    w = Window.partitionBy("arm", "scenario").orderBy("session", "qid")
    return records.withColumn("cold", F.row_number().over(w) == 1)


def pool_gap(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows (pool_hit, hit): their means, the gap, and which stage the rest is lost in."""
    out = rows.groupBy(*by).agg(F.round(F.avg("pool_hit"), 9).alias("pool_hit"), F.round(F.avg("hit"), 9).alias("hit"), F.count("*").alias("n"))
    gap = F.round(F.col("pool_hit") - F.col("hit"), 9)
    return out.withColumn("gap", gap).withColumn("loss", F.when(gap <= 0.05, "generation").when(gap >= 0.15, "ordering").otherwise("mixed"))


def table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of collected summary rows, a few dozen at the most."""
    show = lambda x: "-" if x is None else "inf" if x == float("inf") else (f"{x:.0f}" if abs(x) >= 1000 else f"{x:.3f}") if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])


def aligned(scored: DataFrame, a: str, b: str, value: str) -> DataFrame:
    x, y = (scored.where(F.col("arm") == arm).select("qid", F.col(value).alias(n)) for arm, n in ((a, "a"), (b, "b")))
    return x.join(y, "qid")


def wilcoxon_w(pairs: DataFrame) -> DataFrame:
    """n, w_plus, w_minus over pairs (a, b) that differ; ties have their mean rank."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    # Ranks need one order of all pairs; a count by value is small first.
    v = d.groupBy("m").agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    v = v.withColumn("upto", F.sum("t").over(Window.orderBy("m"))).withColumn("r", F.col("upto") - (F.col("t") - 1) / 2)
    return v.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("plus") * F.col("r")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("t") - F.col("plus")) * F.col("r")), F.lit(0.0)).alias("w_minus"))


def cliffs_delta(pairs: DataFrame) -> DataFrame:
    """P(a > b) - P(a < b) over all combinations, from counts below each value instead of a product of the sides."""
    v = pairs.select(F.col("a").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(pairs.select(F.col("b").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
    v = v.groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    below = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("less", F.coalesce(F.sum("nb").over(below), F.lit(0))).crossJoin(F.broadcast(v.agg(F.sum("nb").alias("tb"), F.sum("na").alias("ta"))))
    return v.agg(F.round(F.sum(F.col("na") * (F.col("less") - (F.col("tb") - F.col("less") - F.col("nb")))) / F.max(F.col("ta") * F.col("tb")), 9).alias("delta"))


def holm(p_values: DataFrame) -> DataFrame:
    """name, p, adjusted: Holm's step-down."""
    order = Window.orderBy("p", "name")
    raw = p_values.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    adj = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return raw.select("name", F.round("p", 12).alias("p"), F.round(adj, 12).alias("adjusted"))
