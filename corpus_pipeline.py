"""A training corpus from documents: quality, near duplicates, benchmark items, secrets, packing.

Every stage takes what the one before kept, written and read again as Parquet, and applies its decisions; all but the
last return the columns of documents.  The result has a row for each piece of a packed sequence.

Null and empty texts are scored by the same vote as others, have no copies, leaks or secrets, and are packed as their end
id alone.  Repeated rows stay together: of a doc_id that repeats, all rows stay or go, and those that stay are packed as
pieces of one document each.  Rows without doc_id can't be named by a decision of the copies and benchmark stages, so they
pass these, and are left out by packing.  Without labels every document passes the first stage; without benchmark items
the third changes nothing; an empty table gives no row.  Further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm.decontamination import as_items, contaminated
from tideline.llm.neardup import near_duplicates
from tideline.llm.packing import pack
from tideline.llm.quality import fit_quality, keep_good
from tideline.llm.secrets import redact

#: Ids that go to every executor at once; more are met by a shuffled join.
MOST_BROADCAST = 1 << 20


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids (written before, so that they can be counted)."""
    n = ids.count()
    return docs.join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "doc_id", "left_anti") if n else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote scores at 0.7 or more."""
    store.light_batches(spark)
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by a similarity of 0.8 in five-word shingles."""
    store.light_batches(spark)
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return _without(docs, store.written(gone, store.scratch(spark, "copies")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    store.light_batches(spark)
    gone = contaminated(docs, as_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).select("doc_id").distinct()
    return _without(docs, store.written(gone, store.scratch(spark, "leaks")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    store.light_batches(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), store.scratch(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
