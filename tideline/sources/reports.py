"""Reports of replays as files: every record, and summaries as a Markdown text.

A folder has a report of the full run and one for each scope, a named part of it; a part never overwrites the full one or
another's.  Records go out as JSON lines by Spark, whole and where they are; what comes to the driver are summary rows, one
for each policy and group, of which there have to be less than MOST_ROWS.  The text is written last, so a report that can
be read has its records beside it; a run that was stopped between the two is written again.

An empty run has a report with headings only.  Nulls show as a dash.  Columns that records have besides go out with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics

#: Summary rows that a text may have.
MOST_ROWS = 10_000
QUALITY = ["queries", "scored_queries", "hit_rate", "mrr", "ndcg10", "mrr_packed", "ndcg10_packed", "evidence_precision", "stale_leak_rate"]
COST = ["task_success", "mean_chars", "budget_utilisation", "chars_per_hit", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "cold_ms", "warm_samples"]


def place(folder: str, scope: str | None = None) -> str:
    """Where the report of a scope is; of the full run without one."""
    if scope is None:
        return f"{folder.rstrip('/')}/full"
    if not re.fullmatch("[A-Za-z0-9_.-]+", scope):
        raise ValueError("a scope is letters, digits, dots, dashes and underscores")
    return f"{folder.rstrip('/')}/scope={scope}"


def lines(records: DataFrame, fields: tuple[str, ...], title: str) -> list[str]:
    """The report's text: a section for all and for each field, with what was found and what it cost."""
    clash = set(fields) & {"arm", "field", "value", "g", "all"}
    if clash:
        raise ValueError(f"no field may be named {sorted(clash)}")
    rows = metrics.summary_by(metrics.per_record(records), *fields).orderBy("field", "value", "arm").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("so many groups don't go into a text")
    found = [r.asDict() for r in rows]
    out = [f"# {title}", ""]
    for field in ("all", *fields):
        some = [r for r in found if r["field"] == field]
        head = ["arm"] if field == "all" else ["value", "arm"]
        name = "All" if field == "all" else f"By {field}"
        for what, columns in (("what was found", QUALITY), ("what it cost", COST)):
            out += [f"## {name}: {what}", "", *metrics.table(some, head + columns).split("\n"), ""]
    return out


def write(records: DataFrame, folder: str, fields: tuple[str, ...] = ("kind", "source"), scope: str | None = None, title: str = "Recall") -> str:
    """Records (metrics.per_record()) and their text in the scope's place, which is returned; what was there goes."""
    at = place(folder, scope)
    spark = records.sparkSession
    records.write.mode("overwrite").option("ignoreNullFields", False).json(f"{at}/records")
    whole = spark.read.schema(records.schema).json(f"{at}/records")
    text = lines(whole, fields, title if scope is None else f"{title}: {scope}")
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/report")
    return at


def read(spark: SparkSession, folder: str, scope: str | None = None) -> str:
    """The text of a report, a few hundred lines."""
    rows = spark.read.text(f"{place(folder, scope)}/report").select("value", F.monotonically_increasing_id().alias("at")).orderBy("at")
    return "\n".join(r["value"] for r in rows.collect())


__all__ = ["COST", "MOST_ROWS", "QUALITY", "lines", "place", "read", "write"]
