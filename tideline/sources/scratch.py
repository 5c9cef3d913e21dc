"""Shared scratch space of the engine: derived tables, written once for each version of a store.

The folder is the session's ``spark.checkpoint.dir``.  Only where it is unset, and only on a local master, a folder of
our own is used, since a machine-local folder is invisible to other machines.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that the driver asks for one by one.
FEW = 256


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name, unique to this call."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tideline-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as Parquet at path, in folders of the columns ``by``, read back: lineage ends at files that survive a lost
    executor."""
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, path: str, key: str, parts: int) -> DataFrame:
    """df as a Parquet table at path, dealt into ``parts`` buckets of key, read back: what groups or joins by the key
    meets without a shuffle."""
    name = f"tideline_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def version(*tables: DataFrame) -> str:
    """A name for the contents of tables on disk: sums over their files' names, sizes and times of change, which a job
    takes from the rows' metadata where there are many files."""
    out = hashlib.sha1()
    for t in tables:
        files = t.inputFiles()
        if len(files) > FEW:
            m = F.col("_metadata")
            per = t.select(m.file_path.alias("f"), m.file_size.alias("n"), m.file_modification_time.alias("at")).groupBy("f", "n", "at").agg(F.lit(1))
            out.update(str(per.agg(F.count("*"), F.sum(F.xxhash64("f", "n", "at").cast("decimal(38,0)"))).first()).encode())
            continue
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for f in sorted(files):
            p = jvm.org.apache.hadoop.fs.Path(f)
            s = p.getFileSystem(conf).getFileStatus(p)
            out.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return out.hexdigest()


_made: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame], by: tuple[str, ...] = (), parts: tuple[str, int] | None = None) -> DataFrame:
    """The derived table ``name`` of the store version ``key``, made and written when first asked for in a session, in
    folders of the columns ``by`` or in ``parts``: a key, and so many buckets."""
    k = (spark.sparkContext.applicationId, name, key)
    if k not in _made:
        _made[k] = keyed(make(), folder(spark, name), *parts) if parts else written(make(), folder(spark, name), by)
    return _made[k]
