"""How long a store takes: its making, its refreshes, and recalls, cold and warm, as rows for reports.

Times are wall clock on the driver around whole Spark actions, so they are informational: they say nothing about results
and differ from run to run.  Of each query the median over passes counts; the first pass pays for the index and is told
apart as cold.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from ..functions import model
from . import ledger, replay, strength

COLUMNS = "arm string, memories long, ingest_s double, refresh_total_s double, cold_ms double, p50_ms double, p95_ms double, total_ms double, passes int"


def timed(f: Callable[[], object]) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def at(values: list[float], q: float) -> float:
    """The value at place floor(q * n) of the sorted values, the last if that is beyond; 0.0 of none."""
    return sorted(values)[min(len(values) - 1, int(q * len(values)))] if values else 0.0


def rows(spark: SparkSession, arms: list[replay.Arm], events: DataFrame, queries: DataFrame, passes: int = 3, budget: int = model.BUDGET) -> DataFrame:
    """A row an arm (COLUMNS): ingest is the fold of the log, refresh its report at the last day; each query is recalled
    by itself, ``passes`` times.  queries: a stated handful, one job each and pass."""
    asked = [r["qid"] for r in queries.select("qid").orderBy("qid").collect()]
    last = (queries.agg({"session": "max"}).first()[0] or 0.0) * model.DAY
    log = events.selectExpr("seq", "op", f"day * {model.DAY} AS ts", "id", "content", "category", "protected", "supersedes")
    out = []
    for arm in arms:
        made = []
        ingest = timed(lambda: made.append(strength.fold(*ledger.resolve(log), last).count()))
        state = strength.fold(*ledger.resolve(log), last)
        refresh = timed(lambda s=state: strength.refresh_report(s, 0.0, last).collect())
        stores, times, cold = replay.Stores(events, queries), [], 0.0
        for turn in range(passes):
            each = []
            for qid in asked:
                each.append(1000 * timed(lambda q=qid, a=arm, s=stores: replay.records(a, s, budget, s.queries.where(f"qid = '{q}'"))[0].select("used", "chars").collect()))
            cold = each[0] if turn == 0 and each else cold
            times.append(each)
        each = [median(x) for x in zip(*times, strict=True)]
        out.append((arm.name, made[0], ingest, refresh, cold, at(each, 0.5), at(each, 0.95), median([sum(x) for x in times] or [0.0]), passes))
    return spark.createDataFrame(out, COLUMNS)
