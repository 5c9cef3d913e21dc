"""Expressions of the offline judge and of reports.  Null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: The names of months.
MONTHS = "january february march april may june july august september october november december".split()
#: Kinds of question by their number; others are lookups.
KINDS = {1: "lookup", 2: "lookup", 3: "continuity", 4: "lookup", 5: "adversarial"}


def numbers(c: Column) -> Column:
    """Distinct runs of digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{Nd}+)"), F.lit(1)))


def months(c: Column) -> Column:
    return F.array_intersect(text.tokens(c), F.array(*map(F.lit, MONTHS)))


def gold_in(gold: Column, haystack: Column) -> Column:
    """Whether a gold answer is in a text that is normalised already: whole, or by a number or a month."""
    g = text.normalized(gold)
    h = F.coalesce(haystack, F.lit(""))
    return F.when(g == "", False).otherwise(h.contains(g) | F.arrays_overlap(numbers(gold), numbers(h)) | F.arrays_overlap(months(gold), months(h)))


def oracle_grade(gold: Column, answer: Column, context: Column, check: Column) -> Column:
    """1.0 or 0.0: equal to the answer if ``check`` is exact, else contained in answer or context."""
    a, g = text.normalized(answer), text.normalized(gold)
    loose = gold_in(gold, F.concat(a, F.lit(" "), text.normalized(context)))
    good = F.when(F.coalesce(gold, F.lit("")) == "", False).when(check == "exact", (a != "") & (a == g)).otherwise(loose)
    return good.cast("double")


def parse_score(raw: Column) -> Column:
    """The score of a judge's reply: a JSON object's, a bare number, a quoted score, or the first 0 or 1 that stands
    alone; null if there is none."""
    t = text.trimmed(F.regexp_replace(text.trimmed(raw), r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    whole = F.when(t.rlike(r"(?s)^\{.*\}$"), F.get_json_object(t, "$.score").try_cast("double")).when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double")
    return F.coalesce(whole, first(r'"score"\s*:\s*([01])\b'), first(r"\b([01])\b"))


def day_of(dialogue: Column) -> Column:
    """The day in the name of a turn such as D3:11; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(dialogue, r"D(\d+):", 1), F.lit("")).cast("int"), F.lit(0))


def kind(category: Column) -> Column:
    out = F.lit("lookup")
    for n, name in KINDS.items():
        out = F.when(category == n, name).otherwise(out)
    return out


def format_p(p: Column) -> Column:
    return F.when(p < 0.001, "p<0.001").otherwise(F.concat(F.lit("p="), F.format_string("%.3f", p)))


def cell(x: Column) -> Column:
    """A number as tables show it."""
    return F.when(x.isNull(), "-").when(x == float("inf"), "inf").when(F.abs(x) >= 1000, F.format_string("%.0f", F.bround(x, 0))).otherwise(F.format_string("%.3f", x))


def nth_of(values: Column, q: float) -> Column:
    """The element at place floor(q * n) of n sorted values, the last if that is beyond; null of none."""
    s = F.array_sort(values)
    at = F.least(F.size(s) - 1, F.floor(F.lit(q) * F.size(s)).cast("int"))
    return F.when(F.size(s) > 0, F.element_at(s, at + 1))
