"""Scenarios and corpora made by rule, as tables: every value is a hash of the seed and the row's number, so a row is the
same wherever and however often it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model

TOPICS = ["garden", "train", "bread", "violin", "harbour", "winter", "letter", "engine", "market", "island", "mirror", "forest"]
THINGS = ["opens at nine", "needs new paint", "was moved to the hall", "costs twelve coins", "belongs to Ada", "closes in autumn", "is kept by the door", "was mended twice"]


def pick(values: list[str], *key) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*key), F.lit(len(values))) + 1).cast("int"))


def corpus(spark: SparkSession, n: int = 10_000, days: int = 60, seed: int = 0, hot: int = 20, tail: int = 2_000) -> DataFrame:
    """A log of n adds over so many days, five accesses to each of the first ``hot`` rows, and one to up to ``tail``
    others on a later day: scenario, seq, day, op, id, content, category, protected, supersedes."""
    i = F.col("id")
    name = lambda c: F.concat(F.lit("s"), F.lpad(c.cast("string"), 8, "0"))
    day = (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(days))).cast("double")
    body = F.concat(F.lit("The "), pick(TOPICS, i, F.lit(seed), F.lit(1)), F.lit(" number "), i.cast("string"), F.lit(" "), pick(THINGS, i, F.lit(seed), F.lit(2)), F.lit("."))
    kind = pick(list(model.RATES), i, F.lit(seed), F.lit(3))
    rows = spark.range(n).select(i.alias("seq"), day.alias("day"), F.lit("add").alias("op"), name(i).alias("id"), body.alias("content"), kind.alias("category"))
    often = spark.range(hot * 5).select((n + i).alias("seq"), (F.lit(days) + i % 5).cast("double").alias("day"), F.lit("access").alias("op"), name(F.floor(i / 5)).alias("id"))
    rare = spark.range(min(tail, n)).select((n + hot * 5 + i).alias("seq"), F.lit(float(days)).alias("day"), F.lit("access").alias("op"), name(F.pmod(F.xxhash64(i, F.lit(seed), F.lit(4)), F.lit(n))).alias("id"))
    out = rows.unionByName(often, allowMissingColumns=True).unionByName(rare, allowMissingColumns=True)
    return out.select(F.lit("scale").alias("scenario"), "seq", "day", "op", "id", "content", "category", F.lit(False).alias("protected"), F.lit(None).cast("string").alias("supersedes"))


def corpus_queries(spark: SparkSession, n: int = 10_000, days: int = 60, seed: int = 0, hot: int = 20, most: int = 5) -> DataFrame:
    """Up to ``most`` questions about hot rows of corpus(), asked after its last day; the row is the evidence."""
    e = corpus(spark, n, days, seed, hot).where(F.col("op") == "add").where(F.col("seq") < min(most, hot))
    topic = pick(TOPICS, F.col("seq"), F.lit(seed), F.lit(1))
    asked = F.concat(F.lit("What is known of "), topic, F.lit(" number "), F.col("seq").cast("string"), F.lit("?"))
    none = F.array().cast("array<string>")
    return e.select(F.concat(F.lit("scale-q"), F.col("seq").cast("string")).alias("qid"), "scenario", F.lit(float(days + 5)).alias("session"), asked.alias("query"), pick(THINGS, F.col("seq"), F.lit(seed), F.lit(2)).alias("answer"), F.array("id").alias("evidence"), none.alias("stale"), F.lit("continuity").alias("kind"), F.lit("scale").alias("source"))


def staleness(spark: SparkSession, how: str, scenarios: int = 3, filler: int = 225, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, queries) in which a fact changes: ``retire`` says so, ``decay`` doesn't, ``update`` supersedes.

    The query asks for the fact; the old row is stale, the new one the evidence.
    """
    if how not in ("retire", "decay", "update"):
        raise ValueError("how a fact goes stale is retire, decay or update")
    s = spark.range(scenarios).select(F.concat(F.lit(f"stale-{how}-"), F.col("id").cast("string")).alias("scenario"), F.col("id").alias("k"))
    topic = pick(TOPICS, F.col("k"), F.lit(seed))
    fact = lambda place: F.concat(F.lit("The key of the "), topic, F.lit(f" hangs {place}."))
    none, no = F.lit(None).cast("string"), F.lit(False)
    row = lambda seq, day, op, id_, content, sup: s.select("scenario", F.lit(seq).cast("long").alias("seq"), F.lit(float(day)).alias("day"), F.lit(op).alias("op"), F.lit(id_).alias("id"), content.alias("content"), F.lit("general").alias("category"), no.alias("protected"), sup.alias("supersedes"))
    out = row(0, 0, "add", "old", fact("behind the stove"), none)
    if how == "retire":
        out = out.unionByName(row(1, 30, "retire", "old", none, none))
    out = out.unionByName(row(2, 30, "add", "new", fact("under the bench"), F.lit("old") if how == "update" else none))
    more = s.crossJoin(F.broadcast(spark.range(filler).select(F.col("id").alias("i"))))  # the scenarios times a stated number
    text = F.concat(F.lit("Note "), F.col("i").cast("string"), F.lit(": the "), pick(TOPICS, F.col("k"), F.col("i"), F.lit(seed)), F.lit(" "), pick(THINGS, F.col("i"), F.lit(seed)), F.lit("."))
    rest = more.select("scenario", (F.col("i") + 10).alias("seq"), (F.col("i") % 30).cast("double").alias("day"), F.lit("add").alias("op"), F.concat(F.lit("f"), F.col("i").cast("string")).alias("id"), text.alias("content"), F.lit("general").alias("category"), no.alias("protected"), none.alias("supersedes"))
    asked = s.select(F.concat("scenario", F.lit("-q")).alias("qid"), "scenario", F.lit(31.0).alias("session"), F.concat(F.lit("Where does the key of the "), topic, F.lit(" hang?")).alias("query"), F.lit("under the bench").alias("answer"), F.array(F.lit("new")).alias("evidence"), F.array(F.lit("old")).alias("stale"), F.lit("staleness").alias("kind"), F.lit({"retire": "staleness", "decay": "staleness-decay", "update": "staleness-update"}[how]).alias("source"))
    return out.unionByName(rest), asked
