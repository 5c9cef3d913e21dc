"""Bounded samples for fitting: which rows are drawn depends on a hash of their key alone, never on their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(key: str, n: int):
    """crc32(key as text) mod n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def drawn(df: DataFrame, key: str, cap: int, seed: int = 11) -> DataFrame:
    """About cap rows of df at the most (all, if there are fewer), and never over 2 * cap."""
    n = df.count()
    if n <= cap:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * cap / n)).limit(2 * cap)


def stretch(text, key: str, longest: int):
    """``longest`` characters of a longer text, from a place that a hash of its key chooses; shorter ones are whole.  So
    no part of long texts is left out by rule."""
    size = F.length(text)
    at = F.when(size > longest, F.pmod(F.xxhash64(key, F.lit(5)), size - longest + 1)).otherwise(F.lit(0))
    return F.col(text).substr((at + 1).cast("int"), F.lit(longest))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed, cap: int, longest: int = 20_000) -> list[tuple[str, int]]:
    """A bounded sample of (text, label): labelled rows that ``allowed`` (a condition on doc_id) admits, of texts of any
    length; of a longer one, a stretch of ``longest`` characters.  The driver holds at most 2 * cap * longest characters.

    Repeated labels of a document count once, by the larger; rows with a null in label, doc_id or text don't count.
    """
    wanted = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y is not null").where(allowed)
    wanted = drawn(wanted.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", cap)
    texts = docs.where("text IS NOT NULL").select("doc_id", stretch("text", "doc_id", longest).alias("text"))
    rows = texts.join(F.broadcast(wanted), "doc_id").orderBy("doc_id", "text").collect()  # at most 2 * cap ids are broadcast
    return [(r["text"], int(r["y"])) for r in rows]
