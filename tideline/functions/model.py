"""Constants of the data model and schemas of its tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds of a day.
DAY = 86400.0
#: Decay a day by category.
RATES = {"identity": 0.002, "preference": 0.010, "user": 0.010, "general": 0.030, "task": 0.050, "ephemeral": 0.100}
#: First strength, share of the rest that an access adds, and the tiers' bounds, which count as below.
INITIAL, BOOST, ACTIVE, LATENT = 0.60, 0.35, 0.5, 0.1
#: Rows ranked a query, terms of a query's dot product, characters, and what a pin adds.
POOL, TERM_LIMIT, BUDGET, PINNED_PRIOR = 600, 48, 2200, 1e6
#: Details a tier may render, richest first, and what they are worth.
LADDER = {"active": ("full", "summary", "gist"), "latent": ("summary", "gist"), "archived": ("gist",)}
WORTH = {"full": 1.0, "summary": 0.55, "gist": 0.25}
#: A store document's version and the fields of its rows.
SCHEMA_VERSION = 3
MEMORY = "id string, content string, summary string, category string, created double, last_access double, access_count bigint, score double, score_at double, protected boolean, tier string, retired boolean, superseded_by string"
#: The log: add, access, retire, pin, in the order of ts and seq. A retire's ``supersedes`` names the row that replaces it.
EVENT = "seq bigint, op string, ts double, id string, content string, category string, protected boolean, supersedes string"


def rate(category: Column) -> Column:
    """Unknown and null categories decay as general."""
    out = F.lit(RATES["general"])
    for name, r in RATES.items():
        out = F.when(F.lower(category) == name, r).otherwise(out)
    return out


def days_since(ts: Column, now: float | Column) -> Column:
    """Never below 0."""
    return F.greatest(F.lit(0.0), (F.lit(now) if isinstance(now, (int, float)) else now) - ts) / DAY


def tier(score: Column, pinned: Column) -> Column:
    return F.when(pinned | (score > ACTIVE), "active").when(score > LATENT, "latent").otherwise("archived")
