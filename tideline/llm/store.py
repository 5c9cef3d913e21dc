"""Shared scratch space: written tables and raw files that every executor can reach.

The folder is the session's ``spark.checkpoint.dir``.  Only where it is unset, and only on a local master, a folder
of our own is used, since a machine-local folder is invisible to other machines.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name, unique to this call, in the shared scratch space."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tideline-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet at path and read it back: lineage ends at files that survive a lost executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; nothing happens if it is gone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are done, which stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder URI; works for file, hdfs, s3, gs and abfs on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:/" + uri.split(":/", 1)[-1].lstrip("/"))


def write_bytes(uri: str, parts, attempt: str) -> None:
    """Write the byte strings of ``parts`` as one file: first under a name of this attempt, then moved into place.

    A retried or speculative task writes the same bytes again, so whichever move comes last leaves a whole file.
    """
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{attempt}.{uuid.uuid4().hex}"
    with files.open_output_stream(aside, compression=None) as out:
        for x in parts:
            out.write(x)
    files.move(aside, path)


def light_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Keep Arrow batches of whole texts small in rows and in bytes (one row at least), so that executors and Python
    workers need little memory for long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
