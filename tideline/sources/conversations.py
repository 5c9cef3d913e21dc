"""Conversation records as scenarios: every turn an add on its session's day, every question a query on the last day.

A record is JSON with sample_id, conversation (a map whose ``session_<n>`` entries are lists of turns; other entries are
ignored) and qa.  A turn is an object with speaker, dia_id and text (or blip_caption), or a list of the first three.
Turns without text or id are dropped, sessions out of order are sorted, and questions are only asked if some of their
evidence is a known turn.  Null fields count as empty; records without turns or questions give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judge, text

SCHEMA = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder: one JSON list a file, or an object a line."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def _field(turn: Column, name: str, at: int) -> Column:
    return text.trimmed(F.coalesce(F.get_json_object(turn, f"$.{name}"), F.get_json_object(turn, f"$[{at}]"), F.lit("")))


def turns(records: DataFrame) -> DataFrame:
    """(scenario, session, at, speaker, dia_id, text) of all turns that can be told apart."""
    e = records.select(F.col("sample_id").alias("scenario"), F.explode("conversation").alias("k", "v")).where(F.col("k").rlike("^session_[0-9]+$"))
    e = e.select("scenario", F.regexp_extract("k", "([0-9]+)$", 1).cast("int").alias("session"), F.posexplode(F.from_json("v", "array<string>")).alias("at", "turn"))
    said = F.when(_field(F.col("turn"), "text", 2) != "", _field(F.col("turn"), "text", 2)).otherwise(_field(F.col("turn"), "blip_caption", 3))
    out = e.select("scenario", "session", "at", _field(F.col("turn"), "speaker", 0).alias("speaker"), _field(F.col("turn"), "dia_id", 1).alias("dia_id"), said.alias("text"))
    return out.where("text <> '' AND dia_id <> ''")


def events(records: DataFrame) -> DataFrame:
    """The log (scenario, seq, day, op, id, content, category, protected, supersedes) of the records."""
    t = turns(records)
    content = F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "), "text")).otherwise(F.col("text"))
    seq = F.col("session").cast("long") * (1 << 20) + F.col("at")
    return t.select("scenario", seq.alias("seq"), judge.day_of(F.col("dia_id")).cast("double").alias("day"), F.lit("add").alias("op"), F.col("dia_id").alias("id"), content.alias("content"), F.lit("ephemeral").alias("category"), F.lit(False).alias("protected"), F.lit(None).cast("string").alias("supersedes"))


def queries(records: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` questions a record with known evidence (0: all): qid, scenario, session, query, answer,
    evidence, stale, kind, source."""
    t = events(records).groupBy("scenario").agg(F.collect_set("id").alias("known"), F.max("day").alias("session"))  # a record's turns
    q = records.select(F.col("sample_id").alias("scenario"), F.posexplode("qa").alias("at", "q")).join(t, "scenario")
    q = q.withColumn("evidence", F.filter(F.coalesce("q.evidence", F.array().cast("array<string>")), lambda x: F.array_contains("known", x))).where(F.size("evidence") > 0)
    per = q.groupBy("scenario").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    q = q.join(per, "scenario")
    q = q.where(F.array_position("ats", F.col("at")) <= most) if most else q
    clean = lambda c: text.trimmed(F.col(c))
    return q.select(F.concat("scenario", F.lit("-q"), F.col("at").cast("string")).alias("qid"), "scenario", "session", clean("q.question").alias("query"), clean("q.answer").alias("answer"), "evidence", F.array().cast("array<string>").alias("stale"), judge.kind(F.col("q.category").try_cast("int")).alias("kind"), F.lit("conversations").alias("source"))
