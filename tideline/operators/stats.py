"""Paired statistics whose formulas have no built-in: exact and normal p-values, bootstrap intervals.

Pairs have a name (the comparison), a qid and the values a and b.  An empty table gives no row; equal values count as ties.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def exact_p(ranks: list[float], w_plus: float) -> float:
    """Two-sided p of the signed-rank sum over all sign patterns; ranks may be halves."""
    ways = {0: 1}
    for r in (round(2 * x) for x in ranks):
        more = dict(ways)
        for s, n in ways.items():
            more[s + r] = more.get(s + r, 0) + n
        ways = more
    seen, total = round(2 * w_plus), 2 ** len(ranks)
    low = sum(n for s, n in ways.items() if s <= seen) / total
    high = sum(n for s, n in ways.items() if s >= seen) / total
    return min(1.0, 2 * min(low, high))


def wilcoxon_p(differences, exact_up_to: int = 20) -> float:
    d = pd.Series([x for x in differences if x])
    n = len(d)
    if not n:
        return 1.0
    r = d.abs().rank()
    plus = float(r[d > 0].sum())
    if n <= exact_up_to:
        return exact_p(r.tolist(), plus)
    mean = n * (n + 1) / 4
    ties = r.value_counts()
    variance = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    if variance <= 0:
        return 1.0
    z = (plus - mean - math.copysign(0.5, plus - mean) * (plus != mean)) / math.sqrt(variance)
    return max(0.0, min(1.0, 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))))


def paired_p(pairs: DataFrame) -> DataFrame:
    """name, n, p for pairs (name, a, b): one group a comparison, a row a query of an evaluation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "n": [len(pdf)], "p": [round(wilcoxon_p(pdf["a"] - pdf["b"]), 12)]})

    return pairs.select("name", "a", "b").groupBy("name").applyInPandas(run, "name string, n long, p double")


#: Modulus of the draws, and the shares of a Poisson(1) variable below 1, 2, ... as far as 1e-9 tells them apart.
PRIME = (1 << 31) - 1
SHARES = [math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def bootstrap(pairs: DataFrame, times: int = 10_000) -> DataFrame:
    """name, low, high: percentile interval (95 %) of the mean difference of pairs (name, qid, a, b) by Poisson bootstrap.

    A pair's weight in replicate r is drawn at the place (x + r * y) mod PRIME, x and y from its qid's MD5; so replicates
    are sums that combine before the shuffle, and any engine draws the same.
    """
    part = lambda at: F.conv(F.substring(F.md5(F.col("qid").cast("binary")), at, 7), 16, 10).cast("long")
    rows = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("name", (F.col("a") - F.col("b")).alias("d"), part(1).alias("x"), (part(9) + 1).alias("y"))
    rows = rows.select("name", "d", "x", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long"))).alias("r"))
    u = ((F.col("x") + F.col("r") * F.col("y")) % PRIME) / float(PRIME)
    w = sum(((u >= c).cast("long") for c in SHARES[1:]), (u >= SHARES[0]).cast("long"))
    means = rows.withColumn("w", w).groupBy("name", "r").agg((F.sum(F.col("d") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy("name").agg(F.round(F.percentile("m", 0.025), 9).alias("low"), F.round(F.percentile("m", 0.975), 9).alias("high"))


def deltas(pairs: DataFrame) -> DataFrame:
    """name, delta: Cliff's delta of each comparison, from counts of the other side below and above each value."""
    side = lambda c, a: F.struct(F.col(c).alias("v"), F.lit(a).alias("na"), F.lit(1 - a).alias("nb"))
    v = pairs.select("name", F.explode(F.array(side("a", 1), side("b", 0))).alias("s")).groupBy("name", "s.v").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    all_, upto = Window.partitionBy("name"), Window.partitionBy("name").orderBy("v")
    v = v.withColumn("upto", F.sum("nb").over(upto)).withColumn("all", F.sum("nb").over(all_))
    won = F.sum(F.col("na") * (F.col("upto") - F.col("nb") - (F.col("all") - F.col("upto"))))
    return v.groupBy("name").agg(F.round(won / (F.sum("na") * F.sum("nb")), 9).alias("delta"))


def paired_summary(pairs: DataFrame, times: int = 10_000) -> DataFrame:
    """Per name of pairs (name, qid, a, b): n, means, mean difference a - b with its interval and deviation, share of
    pairs that a wins (ties half), Cliff's delta and Wilcoxon's p.  Pairs with a null count for nothing."""
    full = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    d = F.col("a") - F.col("b")
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    win = F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)
    sums = full.groupBy("name").agg(F.count("*").alias("n"), mean(F.col("a"), "mean_a"), mean(F.col("b"), "mean_b"), mean(d, "mean_diff"), mean(win, "win_rate"), F.round(F.coalesce(F.stddev_samp(d), F.lit(0.0)), 9).alias("sd_diff"))
    ci = bootstrap(full, times).withColumnsRenamed({"low": "ci_low", "high": "ci_high"})
    return sums.join(ci, "name").join(deltas(full), "name").join(paired_p(full).select("name", F.col("p").alias("p_value")), "name")


def against(scored: DataFrame, hero: str, value: str = "judge_score", times: int = 1_000) -> DataFrame:
    """Every other arm paired with the hero by qid (a: the hero), with Holm's correction over the arms."""
    one = scored.where(F.col("arm") == hero).select("qid", F.col(value).alias("a"))
    pairs = scored.where(F.col("arm") != hero).select(F.col("arm").alias("name"), "qid", F.col(value).alias("b")).join(one, "qid")
    rows = paired_summary(pairs, times).where("n > 1")
    holm_ = metrics.holm(rows.select("name", F.col("p_value").alias("p"))).select("name", F.col("adjusted").alias("p_adjusted"))
    return rows.join(holm_, "name").withColumn("significant", F.col("p_adjusted") < 0.05)


#: The criteria: text, whether its inputs were measured, whether it holds, and whether it counts (else it informs).
CRITERIA = (
    ("characters a hit at most those of order of arrival", "true", "cost <= flat_cost", True),
    ("hit rate within 0.05 of the best baseline", "true", "coalesce(round(base - mine, 9) <= 0.05, true)", True),
    ("best engine within 0.05 of the best baseline", "true", "round(base - best, 9) <= 0.05", True),
    ("under 0.2 of superseded facts surface", "leak IS NOT NULL", "leak < 0.2", True),
    ("decay alone lets superseded facts fade", "fade IS NOT NULL", "fade < 0.2", True),
    ("faster at the 95th percentile than BM25", "late IS NOT NULL", "late < bm25_late", False),
    ("better than both flat baselines", "flats > 0", "flats = beaten", True),
)


def verdict(summaries: DataFrame, leaks: DataFrame, pairs: DataFrame, hero: str, flats: list[str], baselines: list[str], engines: list[str], scale: DataFrame | None = None) -> DataFrame:
    """(n, criterion, status) of CRITERIA over one row of measures.

    summaries: arm, hit_rate, chars_per_hit.  leaks: source, stale_leak_rate of the hero.  pairs: against() the hero.
    scale: arm, p95_ms.  A criterion without inputs is NOT MEASURED; an empty table measures nothing.
    """
    of = lambda arms, c: F.max(F.when(F.col("arm").isin(arms), F.col(c)))
    cost = lambda arm: F.coalesce(of([arm], "chars_per_hit"), F.lit(float("inf")))
    source = lambda s: F.max(F.when(F.col("source") == s, F.col("stale_leak_rate")))
    flat = F.col("name").isin(flats)
    row = summaries.agg(cost(hero).alias("cost"), cost(flats[0]).alias("flat_cost"), F.coalesce(of([hero], "hit_rate"), F.lit(0.0)).alias("mine"), of(baselines, "hit_rate").alias("base"), of(engines, "hit_rate").alias("best"))
    row = row.crossJoin(leaks.agg(source("staleness").alias("leak"), source("staleness-decay").alias("fade")))  # one row each
    row = row.crossJoin(pairs.agg(F.count(F.when(flat, 1)).alias("flats"), F.count(F.when(flat & F.col("significant") & (F.col("mean_diff") > 0), 1)).alias("beaten")))
    row = row.crossJoin(scale.agg(of([hero], "p95_ms").alias("late"), of(["M3"], "p95_ms").alias("bm25_late"))) if scale is not None else row.withColumns({"late": F.lit(None).cast("double"), "bm25_late": F.lit(None).cast("double")})
    status = "CASE WHEN NOT ({m}) THEN 'NOT MEASURED' WHEN NOT {c} THEN 'INFORMATIONAL' WHEN {h} THEN 'PASS' ELSE 'FAIL' END"
    rows = [F.struct(F.lit(n).alias("n"), F.lit(t).alias("criterion"), F.expr(status.format(m=m, c=str(c).lower(), h=h)).alias("status")) for n, (t, m, h, c) in enumerate(CRITERIA, 1)]
    return row.select(F.inline(F.array(*rows)))
