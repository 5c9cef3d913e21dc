"""Budget allocators: greedy packers that skip what does not fit, as one fold over each query's ordered candidates.

A pool has at most 600 rows, so an array of a query's candidates is small at any size of the store, and bodies longer than
the whole budget are never in it; the fold's checks of what is packed already cost at most 600 steps a candidate.  Folds
see lengths alone; ``rendered`` fetches the bodies
of what was packed.  Bodies of no length, null texts among them, are only packed in rank order, where they cost their
separator.  A query without candidates has an empty result where the caller names the queries (``for_all``).  A budget
of 0 or less packs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model, text

USED = "array<struct<id:string,detail:string>>"


def with_bodies(rows: DataFrame, content: str = "content") -> DataFrame:
    """Texts and lengths of the details of each row."""
    c = F.col(content)
    out = rows.withColumn("summary_text", text.summary(c)).withColumn("gist_text", text.gist(c))
    return out.withColumn("full", F.length(c)).withColumn("summary", F.length("summary_text")).withColumn("gist", F.length("gist_text")).withColumn("flat", F.length(text.collapsed(c)))


def _fold(items: Column, step) -> Column:
    return F.aggregate(items, F.struct(F.lit(0).alias("spent"), F.array().cast(USED).alias("used")), step)


def _take(acc: Column, id_: Column, detail: Column, cost: Column) -> Column:
    return F.struct((acc["spent"] + cost).alias("spent"), F.array_append(acc["used"], F.struct(id_.alias("id"), detail.alias("detail"))).alias("used"))


def _gap(acc: Column) -> Column:
    return F.when(F.size(acc["used"]) > 0, 1).otherwise(0)


def _per_query(rows: DataFrame, *items) -> DataFrame:
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*items))).alias("items"))


def _packed(per: DataFrame, step) -> DataFrame:
    """(qid, used: ids and details in the order of the text, chars)."""
    return per.select("qid", _fold(F.col("items"), step).alias("p")).select("qid", "p.used", F.col("p.spent").cast("long").alias("chars"))


def in_order(rows: DataFrame, detail: Column, budget: int = model.BUDGET) -> DataFrame:
    """Bodies of one detail a row (full, summary or gist) in rank order."""
    cost = F.when(detail == "full", F.col("full")).when(detail == "summary", F.col("summary")).otherwise(F.col("gist"))

    def step(acc, x):
        total = x["cost"] + _gap(acc)
        return F.when(acc["spent"] + total <= budget, _take(acc, x["id"], x["detail"], total)).otherwise(acc)

    fit = rows.select("qid", "rank", "id", cost.alias("cost"), detail.alias("detail")).where(F.col("cost") <= budget)
    return _packed(_per_query(fit, "rank", "id", "cost", "detail"), step)


def tiered(rows: DataFrame, budget: int = model.BUDGET) -> DataFrame:
    """In rank order, each row at the richest detail of its tier that still fits."""
    body = lambda d: F.struct(F.col(d).alias("cost"), F.lit(d).alias("detail"))
    bodies = F.array(body("gist"))
    for tier, details in model.LADDER.items():
        bodies = F.when(F.col("tier") == tier, F.array(*map(body, details))).otherwise(bodies)

    def step(acc, x):
        fits = F.filter(x["bodies"], lambda b: acc["spent"] + b["cost"] + _gap(acc) <= budget)
        best = F.get(fits, F.lit(0))
        return F.when(F.size(fits) > 0, _take(acc, x["id"], best["detail"], best["cost"] + _gap(acc))).otherwise(acc)

    return _packed(_per_query(rows, "rank", "id", bodies.alias("bodies")), step)


def by_worth(rows: DataFrame, budget: int = model.BUDGET) -> DataFrame:
    """All (row, detail) with utility by value for each character, the best first, a row at most once."""
    ladder = [(t, d, i) for t, ds in model.LADDER.items() for i, d in enumerate(ds)]
    details = F.filter(
        F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(i).alias("ord"), F.col(d).alias("cost"), F.lit(model.WORTH[d]).alias("worth"), F.lit(d).alias("detail")) for t, d, i in ladder]),
        lambda x: (x["tier"] == F.col("tier")) & (x["cost"] > 0) & (x["cost"] <= budget),
    )
    options = rows.where("utility > 0").select("qid", "id", "utility", F.explode(details).alias("o"))
    options = options.withColumn("r", -F.round(F.col("utility") * F.col("o.worth") / F.col("o.cost"), 12))

    def step(acc, x):
        total = x["cost"] + _gap(acc)
        new = ~F.exists(acc["used"], lambda u: u["id"] == x["id"])
        return F.when((acc["spent"] + total <= budget) & new, _take(acc, x["id"], x["detail"], total)).otherwise(acc)

    return _packed(_per_query(options, "r", "id", "o.ord", "o.cost", "o.detail"), step)


def truncated(rows: DataFrame, budget: int = model.BUDGET, least: int = 40, bodies: DataFrame | None = None, few: bool = False, key: str = "id") -> DataFrame:
    """Rank order, each text cut to what is left; stops when under ``least`` characters are.  A cut body may be shorter
    than its room by blanks before the ellipsis.  A detail is the room, as text.

    A text that doesn't fit takes all that is left but a blank, so rows behind it are never reached: lengths alone say how
    far a query gets, and only these texts are fetched (from ``bodies``: key, content; else rows have them),
    by a broadcast of what they are for ``few`` queries.
    """
    size = F.col("flat") if "flat" in rows.columns else F.length(text.collapsed(F.col("content")))
    slim = rows.select(*dict.fromkeys(["qid", "rank", "id", key]), size.alias("size"), *([] if bodies is not None else ["content"])).where("size > 0")
    before = F.sum(F.col("size") + 1).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    near = slim.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= budget)
    near = (F.broadcast(near) if few else near).join(bodies.select(key, "content"), key) if bodies is not None else near
    per = _per_query(near, "rank", "id", F.substring(text.collapsed(F.col("content")), 1, max(0, budget) + 1).alias("flat"))

    def step(acc, x):
        left = budget - acc["spent"] - _gap(acc)
        size = F.when(F.length(x["flat"]) <= left, F.length(x["flat"])).otherwise(F.length(F.rtrim(F.substring(x["flat"], F.lit(1), left - 3))) + 3)
        return F.when((left >= least) & (size > 0), _take(acc, x["id"], left.cast("string"), size + _gap(acc))).otherwise(acc)

    return _packed(per, step)


def ladder_tier(rank: Column) -> Column:
    """Tiers by rank alone: 1 to 8, 9 to 24, the rest."""
    return F.when(rank <= 8, "active").when(rank <= 24, "latent").otherwise("archived")


def ladder_detail(rank: Column) -> Column:
    return F.when(rank <= 8, "full").when(rank <= 24, "summary").otherwise("gist")


def for_all(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for every query; an empty result for those without candidates."""
    out = queries.select("qid").distinct().join(packed, "qid", "left")
    return out.select("qid", F.coalesce("used", F.array().cast(USED)).alias("used"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


def ids(packed: DataFrame) -> DataFrame:
    """(qid, used_count, chars, used_ids joined by commas)."""
    return packed.select("qid", F.size("used").cast("long").alias("used_count"), "chars", F.array_join(F.transform("used", lambda u: u["id"]), ",").alias("used_ids"))


def rendered(packed: DataFrame, state: DataFrame, few: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """packed with ``text``, the bodies joined by line ends, and ``tiers``, how many rows of each tier they are.  few: what
    is packed may go to every executor.  texts: bodies by identity, which state then has instead of them."""
    u = packed.select("qid", F.posexplode("used").alias("at", "u")).select("qid", "at", F.col("u.id").alias("id"), F.col("u.detail").alias("detail"))
    d = F.col("detail")
    flat = text.collapsed(F.col("content"))
    room = d.try_cast("int")
    cut = F.when(F.length(flat) <= room, flat).otherwise(F.concat(F.rtrim(F.substring(flat, F.lit(1), room - 3)), F.lit("...")))
    body = F.when(d == "full", F.col("content")).when(d == "summary", F.col("summary_text")).when(d == "gist", F.col("gist_text")).otherwise(cut)
    bodies = ["content", "summary_text", "gist_text"]
    rows = (F.broadcast(u) if few else u).join(state.select("id", *(bodies if texts is None else ["identity"]), "tier"), "id")
    rows = (rows if texts is None else rows.join(texts.select("identity", *bodies), "identity")).select("qid", "at", body.alias("body"), "tier")
    per = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("b"), F.collect_list("tier").alias("t"))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("t")), lambda k: F.struct(k, F.size(F.filter("t", lambda x: x == k)))))
    per = per.select("qid", F.array_join(F.transform("b", lambda x: x["body"]), "\n").alias("text"), counts.alias("tiers"))
    out = packed.join(per, "qid", "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tiers", F.coalesce("tiers", F.create_map().cast("map<string,int>")))


def stub(id_: Column) -> Column:
    """What a detail that is none of the ladder's renders."""
    return F.concat(F.lit("["), id_, F.lit("] (archived)"))
