"""The write path: a log of adds and events to rows and the events that count for them.

An add of a text that is live collapses: it is an access of the row that holds the text, and a pin if it is protected.
Any other add makes a row.  An add may supersede a row, which is then retired by it.  So the adds of a text fall into
generations, cut by the retires that name its rows; in a generation the first add makes a row, unless the row before it
still lives, since retires of rows that were never made, or died before, do nothing.

Generations are counted by a window over those texts alone that some retire names; adds combine by text and generation
before they meet; what is folded in order is one entry a generation.

Adds without text (null or blank) and events with a null ts or op are dropped, as the front doors refuse them.  An add
without id gets one of its text's digest, and a number behind it if other rows have the same.  Adds whose id is taken by
an earlier add, and events of unknown rows, are dropped.  A retire may name the row that replaces its own.

A base is a snapshot: rows that were there before the log.  Its live rows own their texts (of equal ones the last made),
its ids are taken, and numbers behind digests go on from it.  Order is by ts, then add before retire before others, then seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import scratch
from . import strength

def _order(op: Column) -> Column:
    """Within one time."""
    return F.when(op == "add", 0).when(op == "retire", 1).otherwise(2)


def numbered_ids(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """rows (content, or digest where there is no id; id or null, ts, seq) with an id each: the given one, or the text's
    digest; of rows with one digest the second and later ones get -2, -3, ... in their order, after those of the base (id)."""
    made = rows if "digest" in rows.columns else rows.withColumn("digest", F.when(F.col("id").isNull(), text.content_id(F.col("content"))))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("ts", "seq"))
    given = made.where("digest IS NULL")
    own = made.where("digest IS NOT NULL").withColumn("nth", nth)
    if base is not None:
        # The largest number behind a digest; the digest alone is number 1.
        before = base.select(F.regexp_extract("id", "^(m-[0-9a-f]{10})(-[0-9]+)?$", 1).alias("digest"), F.coalesce(F.nullif(F.regexp_extract("id", "^m-[0-9a-f]{10}-([0-9]{1,9})$", 1), F.lit("")).cast("int"), F.lit(1)).alias("number"))
        before = before.where("digest <> ''").groupBy("digest").agg(F.max("number").alias("before"))
        own = own.join(before, "digest", "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before")
    own = own.withColumn("id", F.when(F.col("nth") == 1, F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.col("nth").cast("string")))).drop("nth")
    return given.unionByName(own).drop("digest")


def resolve(log: DataFrame, stale_retirement: bool = True, base: DataFrame | None = None, as_called: bool = False, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows: id, content, category, created, seq, superseded_by; events: seq, id, op, ts) of a log of model.EVENT.
    as_called: events of one time are in the order of seq alone.  With a base of such rows and strength.SNAPSHOT's columns (seq below 0), rows have these, too.

    The events are what strength.fold() takes: explicit ones on rows that exist, collapsed adds as accesses (and pins),
    protected rows as pins from the start, supersessions as retires.  Without ``stale_retirement`` nothing is superseded.

    A log may have ``identity`` (text.identity() of the text, null for none) instead of content: rows are the same but
    without content, and no text is dealt out.  Its adds need ids, and it takes no base.
    """
    body = [c for c in ("content",) if c in log.columns]
    if not body and base is not None:
        raise ValueError("a log without texts takes no base")
    folder = scratch.folder(log.sparkSession, "ledger")
    kept = lambda df, name: scratch.written(df, f"{folder}/{name}")  # noqa: E731  each step feeds several others
    e = log.where("ts IS NOT NULL AND op IS NOT NULL").withColumn("o", _order(F.col("op")))
    adds = e.where("op = 'add'")
    if body:
        adds = adds.withColumn("content", text.trimmed(F.col("content"))).where("content <> ''").withColumn("identity", text.identity(F.col("content")))
    else:
        adds = adds.where("identity IS NOT NULL AND id IS NOT NULL")
    adds = adds.withColumn("category", F.lower(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("general"))))
    place = lambda o: F.struct("ts", F.col("seq").alias("x"), o.cast("long").alias("y")) if as_called else F.struct("ts", o.cast("long").alias("x"), F.col("seq").alias("y"))
    at = place(F.col("o"))
    if base is not None:
        adds = adds.join(base.select(F.col("id").alias("taken")), F.col("id") == F.col("taken"), "left_anti")
        live = base.where("NOT gone").withColumn("identity", text.identity(F.col("content")))
        owners = live.groupBy("identity").agg(F.max_by(F.struct("id", "content", "category", "seq"), F.struct("created", "id")).alias("o")).select("identity", "o.*")
        first = owners.withColumns({"op": F.lit("add"), "ts": F.lit(float("-inf")), "protected": F.lit(False), "o": F.lit(0), "supersedes": F.lit(None).cast("string")})
        adds = adds.unionByName(first.select(*adds.columns))
    named = adds.where("id IS NOT NULL").groupBy("id").agg(F.min(at).alias("first"))
    adds = adds.withColumn("at", at).join(named, "id", "left").where("id IS NULL OR at = first").drop("first")
    adds = kept(adds, "adds")
    # Which text's rows a retire names. An id that no add gave is a digest, with or without a number.
    owners = adds.where("id IS NOT NULL").select(F.col("id").alias("target"), "identity")
    digest = text.content_id(F.col("content")) if body else F.lit(None).cast("string")
    digests = adds.where("id IS NULL").select(digest.alias("digest"), "identity").distinct()
    retires = e.where("op = 'retire'").select(F.col("id").alias("target"), at.alias("at"))
    if stale_retirement:
        retires = retires.unionByName(adds.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("target"), place(F.lit(1)).alias("at")))
    known = retires.join(owners, "target")
    known = known.unionByName(retires.join(owners, "target", "left_anti").withColumn("digest", F.regexp_extract("target", "^(m-[0-9a-f]{10})", 1)).join(digests, "digest").drop("digest"))
    known = kept(known, "known")
    cut = known.select("identity").distinct()
    marks = adds.select("identity", "at", F.lit(0).alias("r")).join(cut, "identity", "left_semi").unionByName(known.select("identity", "at", F.lit(1).alias("r")))
    order = Window.partitionBy("identity").orderBy("at")
    gens = kept(marks.withColumn("g", F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0))), "gens")
    adds = adds.join(gens.where("r = 0").select("identity", "at", "g"), ["identity", "at"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    # A generation's first add and the retire that opens it, folded to which generations make a row.
    heads = adds.groupBy("identity", "g").agg(F.min_by(F.struct("seq", "id"), "at").alias("head"), F.min("at").alias("at"))
    cuts = gens.where("r = 1").select("identity", F.col("g"), F.col("at").alias("cut")).join(known.select("identity", F.col("at").alias("cut"), "target"), ["identity", "cut"])
    per = heads.join(cut, "identity", "left_semi").join(cuts, ["identity", "g"], "full").groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("g", "target", F.col("head.seq").alias("seq"), F.col("head.id").alias("id")))).alias("gens"))
    none = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(False).alias("live"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("makes"))

    def step(acc, x):
        # Rows whose id comes from the text are told apart by their number among the rows made: '' stands for them.
        mine = (x["target"] == acc["owner"]) | ((acc["owner"] == "") & x["target"].rlike("^m-[0-9a-f]{10}"))
        live = acc["live"] & ~F.coalesce(mine, F.lit(False))
        makes = x["seq"].isNotNull() & ~live
        return F.struct(
            F.when(makes, F.coalesce(x["id"], F.lit(""))).otherwise(acc["owner"]).alias("owner"), (live | makes).alias("live"), (acc["n"] + makes.cast("int")).alias("n"),
            F.when(makes, F.array_append(acc["makes"], x["seq"])).otherwise(acc["makes"]).alias("makes"),
        )

    makes = per.select("identity", F.explode(F.aggregate("gens", none, step, lambda acc: acc["makes"])).alias("seq"))
    makes = makes.unionByName(heads.join(cut, "identity", "left_anti").select("identity", F.col("head.seq").alias("seq")))
    made = adds.join(makes, ["identity", "seq"], "left_semi").select("identity", "id", *body, "category", "ts", "seq", "at", "protected")
    made = numbered_ids(made, base) if body else made
    made = kept(made, "made")
    ids = made.select("id") if base is None else made.select("id").union(base.select("id")).distinct()
    # A collapsed add belongs to the last row of its text made before it; without retires there is one row a text.
    slim = adds.select("identity", "at", "seq", "ts", "protected", "supersedes")
    keyed = slim.join(cut, "identity", "left_semi").join(made.select("identity", "at", F.col("id").alias("row")), ["identity", "at"], "left")
    placed = keyed.withColumn("of", F.last("row", True).over(order))
    plain = slim.join(cut, "identity", "left_anti").join(made.select("identity", F.col("id").alias("of"), F.col("at").alias("first")), "identity")
    placed = placed.unionByName(plain.withColumn("row", F.when(F.col("at") == F.col("first"), F.col("of"))).drop("first"))
    placed = kept(placed, "placed")
    events = [
        placed.where("row IS NULL").select("seq", F.col("of").alias("id"), F.lit("access").alias("op"), "ts"),
        placed.where("protected").select("seq", F.col("of").alias("id"), F.lit("pin").alias("op"), "ts"),
        e.where("op IN ('access', 'pin', 'retire')").join(ids, "id", "left_semi").select("seq", "id", "op", "ts"),
    ]
    # Which row replaced one: a later add that superseded it, or what its retire names; the last word counts.
    swaps = e.where("op = 'retire' AND supersedes IS NOT NULL").join(ids, "id", "left_semi").select("id", F.col("supersedes").alias("of"), "ts", "seq")
    if stale_retirement:
        newer = placed.where("supersedes IS NOT NULL AND supersedes <> of").join(ids.select(F.col("id").alias("supersedes")), "supersedes", "left_semi")
        newer = newer.select(F.col("supersedes").alias("id"), "of", "ts", "seq")
        events.append(newer.select("seq", "id", F.lit("retire").alias("op"), "ts"))
        swaps = swaps.unionByName(newer)
    superseded = swaps.groupBy("id").agg(F.max_by("of", F.struct("ts", "seq")).alias("superseded_by"))
    out = events[0]
    for x in events[1:]:
        out = out.unionByName(x)
    rows = made.select("id", *body, *(["identity"] if keep else []), "category", F.col("ts").alias("created"), "seq")
    if base is None:
        return rows.join(superseded, "id", "left"), out
    rows = rows.where("seq >= 0").withColumn("before", F.lit(None).cast("string"))
    old = base.select(*rows.columns[:-1], F.col("superseded_by").alias("before"), *strength.snapshot(base))
    rows = rows.select("*", *strength.snapshot(rows)).unionByName(old).join(superseded, "id", "left")
    return rows.withColumn("superseded_by", F.coalesce("superseded_by", "before")).drop("before"), out
