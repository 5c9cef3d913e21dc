"""Stores on disk: JSON documents of a version with a list of memories, and Parquet."""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model, text

ENV = "TIDELINE_STORE"


def store_path(path: str | None = None, default: str = "tideline-store.json") -> str:
    return os.path.realpath(path or os.environ.get(ENV) or default)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Memories of a store; an older version gets score_at, a newer one is refused."""
    fields = "schema string, memories array<struct<" + ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in model.MEMORY.split(", ")) + ">>"
    doc = spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)
    version = doc.select("schema").first()
    if version is None:
        raise ValueError("not a store")
    v = version[0] if version[0] is not None else "2"
    if not v.isdigit():
        raise ValueError(f"schema is not a whole number: {v}")
    if int(v) > model.SCHEMA_VERSION:
        raise ValueError(f"schema {v} is newer than {model.SCHEMA_VERSION}")
    m = doc.select(F.explode("memories").alias("m")).select("m.*")
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    m = m.withColumn("score_at", F.coalesce(zero("score_at"), zero("last_access"), zero("created"), F.lit(0.0)))
    m = m.withColumn("summary", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), text.summary(F.col("content"))))
    m = m.withColumn("protected", F.coalesce("protected", F.lit(False))).withColumn("retired", F.coalesce("retired", F.lit(False)))
    return m.withColumn("tier", model.tier(F.col("score"), F.col("protected")))


def write_json(memories: DataFrame, path: str) -> str:
    """One document, for stores that fit the driver: written aside, synced, moved into place. Use write_parquet beyond."""
    names = [c.split()[0] for c in model.MEMORY.split(", ")]
    rows = [json.loads(r) for r in memories.select(*names).orderBy("id").toJSON().toLocalIterator()]
    fd, aside = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump({"schema": model.SCHEMA_VERSION, "memories": rows}, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)
    return path


def write_parquet(memories: DataFrame, path: str) -> None:
    memories.write.mode("overwrite").parquet(path)


def _local(spark: SparkSession, path: str) -> str:
    """The URI of a plain path, which only a local master's executors can reach."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster a store is exchanged as Parquet in a shared folder (write_parquet), not at a plain path")
    return f"file://{os.path.realpath(path)}"


def write_store(spark: SparkSession, base: DataFrame | None, log: DataFrame, path: str) -> str:
    """A store as its base and log: a new folder of Parquet, then a pointer to it, moved into place."""
    version = f"{path}.d/{uuid.uuid4().hex}"
    root = _local(spark, version)
    log.write.parquet(f"{root}/log")
    if base is not None:
        base.write.parquet(f"{root}/base")
    fd, aside = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump({"schema": model.SCHEMA_VERSION, "store": version, "base": base is not None}, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)
    return path


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(base, log) of a store; a document of rows is a base."""
    with open(path) as f:
        head = json.load(f)
    if not isinstance(head, dict):
        raise ValueError("not a store")
    if "store" not in head:
        return base_of(read_json(spark, _local(spark, path))), spark.createDataFrame([], model.EVENT)
    if not isinstance(head.get("schema"), int) or isinstance(head["schema"], bool) or head["schema"] > model.SCHEMA_VERSION:
        raise ValueError(f"schema {head.get('schema')} is not one of this store's")
    root = _local(spark, head["store"])
    return spark.read.schema(BASE).parquet(f"{root}/base") if head["base"] else None, spark.read.schema(model.EVENT).parquet(f"{root}/log")


#: Rows of a base: what identity needs, and what a fold goes on from.
BASE = "id string, content string, category string, created double, superseded_by string, score double, score_at double, access_count bigint, used double, protected boolean, gone boolean, seq bigint"


def base_of(memories: DataFrame) -> DataFrame:
    """Rows of a store document as a base: their scores, uses, pins and replacements count as they are."""
    number = -1 - F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))
    return memories.select("id", "content", "category", "created", "superseded_by", "score", "score_at", "access_count", F.col("last_access").alias("used"), "protected", F.col("retired").alias("gone"), number.alias("seq"))


class Owner:
    """Exclusive ownership of a store: a lock file beside it that one process holds."""

    def __init__(self, path: str):
        self.file = open(f"{path}.lock", "w")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise RuntimeError(f"{path} belongs to another process") from e

    def close(self) -> None:
        if not self.file.closed:
            fcntl.flock(self.file, fcntl.LOCK_UN)
            self.file.close()

    def __enter__(self) -> Owner:
        return self

    def __exit__(self, *_) -> None:
        self.close()
