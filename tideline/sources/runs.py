"""Runs in parts that can go on where they were stopped: a folder with what the run is, and a table for each part.

The folder's manifest names the run: its inputs' version and settings.  A part is done when its table is whole, which
Spark's committer marks; a part that was stopped is made again from the start, so it is never half there.  A folder of
another run is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, uri: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, uri: str) -> str | None:
    fs, p = _path(spark, uri)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(uri).collect())  # a manifest of one line


def begun(spark: SparkSession, folder: str, identity: dict) -> None:
    """Start or go on with a run; ValueError if the folder holds another."""
    said = json.dumps(identity, sort_keys=True)
    before = _read(spark, f"{folder}/manifest")
    if before is None:
        spark.createDataFrame([(said,)], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    elif before != said:
        raise ValueError(f"{folder} holds another run: {before}")


def in_parts(spark: SparkSession, folder: str, identity: dict, parts: Iterable[tuple[str, Callable[[], DataFrame]]]) -> DataFrame | None:
    """All parts (name, make) of a run, each made and written unless it is there already; None without parts."""
    begun(spark, folder, identity)
    out = None
    for name, make in parts:
        at = f"{folder}/part={name}"
        fs, mark = _path(spark, f"{at}/_SUCCESS")
        if not fs.exists(mark):
            make().write.mode("overwrite").parquet(at)
        part = spark.read.parquet(at)
        out = part if out is None else out.unionByName(part)
    return out
