"""Operator 9: secrets by fixed patterns and by sliding-window Shannon entropy, in DataFrame functions alone.

Base spans are the matches of three patterns.  The method adds candidate strings, runs of 20 and more characters of a
base64 or URL alphabet that mix letters and digits, in which some window of ``WINDOW`` characters has an entropy at or
above the limit of the candidate's character class.  The entropy of a window is log2(w) - sum(n log2 n) / w over the
counts n of its characters; moving the window by one changes two counts, and the sum is kept by these changes.
Base spans, dates and words of samples are cut out of a candidate, and each rest that still has 20 characters is one of
its own, so a secret glued to them is found.  Rests that are wholly what the allow-list describes (paths, words joined
by hyphens, digits alone) are dropped.

Positions are code points, ends exclusive.  Null texts are empty: no spans, and the SHA-256 of the empty string.
Repeated rows and rows without doc_id stay rows.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN_HEAD = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern, least length of the match behind ``head``). Where a shorter run can't hide a longer match, the
#: least length is in the pattern itself.
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
#: Counts of a window, in bits, and how many of them a word of 64 bits takes.
COUNT_BITS, PER_WORD = 5, 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a window must reach, by class; uniform random windows of 20 have 3.2, 3.9 and 4.1 bits on the average.
LIMITS = {"hex": 2.85, "alnum": 3.55, "base64": 3.75}
#: What a candidate may be without being a secret: words joined by signs, dates, paths and addresses, digits alone.
ALLOWED = (
    r"^[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*[0-9]{0,4}$",
    r"^[0-9_/=+-]+$",
    r"^/*(?:[A-Za-z]+[0-9]{0,4}[-_/]+)+[A-Za-z0-9]{0,12}$",
)
#: What is cut out of a candidate, and how long it is.
PIECES = ((r"(?:19|20)[0-9]{2}[-/][0-9]{2}[-/][0-9]{2}", 10), *((f"(?i){w}", len(w)) for w in ("example", "sample", "placeholder", "changeme", "xxxx", "0000", "1234567")))
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches of a pattern, which never are empty.

    The gaps between the matches are what split() returns, so positions are running sums of lengths.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(empty)


def _plog(n: Column) -> Column:
    """n log2 n, 0 at 0, from a table of the counts a window can have."""
    return F.element_at(F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)]), n + 1)


def peak_entropy(value: Column, w: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of w characters; shorter values have none (0).

    The state holds the counts of all character codes, twelve of them in a 64-bit word, the sum of n log2 n, and the
    least such sum so far; a step changes two of the words.  Codes that leave are zipped with those that enter, so the
    work grows with the length of the value alone.
    """
    if w >= 1 << COUNT_BITS:
        raise ValueError("a count must fit its bits")
    codes = F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    pairs = F.slice(F.arrays_zip(codes.alias("new"), F.concat(F.array_repeat(F.lit(-1), w), codes).alias("old")), F.lit(1), F.size(codes))
    word = lambda c: (c / PER_WORD).cast("int")
    place = lambda c: c % PER_WORD * COUNT_BITS
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c))
    count = lambda n, c: F.call_function("shiftright", F.element_at(n, word(c) + 1), place(c)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    old = lambda x: F.greatest(x["old"], F.lit(0))
    leaves = lambda x: x["old"] >= 0
    steps = F.transform(pairs, lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), word(x["new"]).alias("to"), word(old(x)).alias("from"), one(x["new"]).alias("plus"), F.when(leaves(x), one(old(x))).otherwise(F.lit(0).cast("long")).alias("minus"), (i >= w - 1).alias("full")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-128 // PER_WORD)).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def move(acc, x):
        up, down = count(acc["n"], x["new"]), count(acc["n"], old(x))
        change = _plog(up + 1) - _plog(up) + F.when(leaves(x), _plog(F.greatest(down, F.lit(1)) - 1) - _plog(down)).otherwise(F.lit(0.0))
        s = acc["s"] + F.when(x["new"] == x["old"], F.lit(0.0)).otherwise(change)
        n = F.transform(acc["n"], lambda k, j: k + F.when(j == x["to"], x["plus"]).otherwise(0) - F.when(j == x["from"], x["minus"]).otherwise(0))
        return F.struct(n.alias("n"), s.alias("s"), F.when(x["full"], F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    return F.aggregate(steps, start, move, lambda acc: F.when(acc["least"] > 1e8, F.lit(0.0)).otherwise(F.lit(math.log2(w)) - acc["least"] / w))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _cut(m: Column, spans: Column) -> Column:
    """The value of a candidate m with blanks for what the spans, and pieces that are no secrets, take of it."""

    def blank(v, b):
        start, end = F.greatest(b["start"] - m["start"], F.lit(0)), F.least(b["end"], m["end"]) - m["start"]
        return F.concat(F.substring(v, F.lit(1), start), F.repeat(F.lit(" "), end - start), F.substring(v, end + 1, F.length(v)))

    out = F.aggregate(F.filter(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), m["value"], blank)
    for pattern, size in PIECES:
        out = F.regexp_replace(out, pattern, " " * size)
    return out


def suspicious(value: Column) -> Column:
    """Whether a candidate string mixes letters and digits, is on no allow-list, and has a window of high entropy."""
    mixed = _mixed(value)
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | value.rlike(p)
    limit = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), LIMITS["alnum"]).otherwise(LIMITS["base64"])
    # One branch after the other: only what passes the cheap tests has its windows counted.
    return F.when(~mixed, False).when(allowed, False).otherwise(F.round(peak_entropy(value), 9) >= limit)


def _free(docs: DataFrame, name: str) -> str:
    """name, or the first of _name, __name, ... that is no column of docs."""
    while name in docs.columns:
        name = "_" + name
    return name


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with a further column ``into``: struct of ``base`` and ``found``, arrays of struct<start, rank, end, kind>,
    the spans of the patterns and all spans, by start and then kind.  A column of that name is refused."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(located(t, ASSIGN), lambda m: F.length(F.regexp_replace(m["value"], "^" + ASSIGN_HEAD, "")) >= 6)
    kinds = [("assign", assign), ("access", located(t, ACCESS)), ("hex", located(t, HEX))]

    def tagged(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    # Each column is computed once: later ones refer to it by name.
    base, maybe = _free(docs, f"{into}_base"), _free(docs, f"{into}_maybe")
    out = docs.withColumn(base, F.concat(*[tagged(k, s) for k, s in kinds])).withColumn(maybe, located(t, CANDIDATE))
    rest = lambda m: F.struct(m["start"].alias("at"), _cut(m, F.col(base)).alias("value"))
    out = out.withColumn(maybe, F.transform(F.filter(maybe, lambda m: _mixed(m["value"])), rest))
    hot = lambda r: F.filter(located(r["value"], CANDIDATE), lambda m: suspicious(m["value"]))
    moved = lambda r: F.transform(hot(r), lambda m: F.struct((r["at"] + m["start"]).alias("start"), (r["at"] + m["end"]).alias("end")))
    out = out.withColumn(maybe, F.flatten(F.transform(maybe, moved)))
    every = F.array_sort(F.concat(base, tagged("entropy", F.col(maybe))))
    return out.withColumn(into, F.struct(F.array_sort(base).alias("base"), every.alias("found"))).drop(base, maybe)


def written_out(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with every span of ``text`` replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    into = _free(docs, "secrets")
    found = find_secrets(docs, text, into)
    spans = F.col(f"{into}.found")
    t = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        gap = F.substring(t, acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))
        inside = m["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop(into)


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("secrets.base", lambda m: m["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written_out(F.col("secrets.base")), 256).alias("base_sha256"),
        written_out(F.col("secrets.found")).alias("spans"),
    )


def _sql_spans(kind: str, pattern: str, keep: str = "true", table: str = "d") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, rid, '{kind}' AS kind, {ORDER[kind]} AS rnk, s AS a, s + length(v) AS b, v FROM (
      SELECT doc_id, rid, v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, rid, hits, gaps, unnest(hits) AS v, generate_subscripts(hits, 1) AS i
            FROM (SELECT doc_id, rid, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM {table}))) WHERE {keep}"""


_HEAD = ASSIGN_HEAD.replace("'", "''")
_ALLOW = " OR ".join(f"regexp_matches(v, '{p}')" for p in ALLOWED)
_CUT = "array_to_string(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN len(list_filter(spans, lambda x: x.a < m.a + i AND m.a + i <= x.b)) > 0 THEN ' ' ELSE v[i] END), '')"
for _pattern, _size in PIECES:
    _CUT = f"regexp_replace({_CUT}, '{_pattern}', '{' ' * _size}', 'g')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
base AS ({_sql_spans("assign", ASSIGN, f"length(regexp_replace(v, '^{_HEAD}', '')) >= 6")}
  UNION ALL {_sql_spans("access", ACCESS)}
  UNION ALL {_sql_spans("hex", HEX)}),
maybe AS ({_sql_spans("entropy", CANDIDATE, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}),
met AS (SELECT m.doc_id, m.rid, m.a, any_value(m.v) AS v, coalesce(list({{'a': x.a, 'b': x.b}}) FILTER (WHERE x.a IS NOT NULL), []) AS spans
  FROM maybe m LEFT JOIN base x ON x.rid = m.rid AND x.a < m.b AND m.a < x.b GROUP BY ALL),
rest AS (SELECT doc_id, rid AS doc, a AS at, row_number() OVER () AS rid, {_CUT} AS t FROM met m),
left_ AS ({_sql_spans("entropy", CANDIDATE, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')", "rest")}),
hot AS (SELECT l.doc_id, r.doc AS rid, l.kind, l.rnk, r.at + l.a AS a, r.at + l.b AS b, l.v FROM left_ l JOIN rest r ON r.rid = l.rid
  WHERE NOT ({_ALLOW})
    AND round(list_max(list_transform(range(1, length(v) - {WINDOW} + 2), lambda i: list_entropy(string_split(v[i:i + {WINDOW} - 1], '')))), 9) >=
      CASE WHEN regexp_matches(v, '^([0-9a-f]+|[0-9A-F]+)$') THEN {LIMITS["hex"]} WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN {LIMITS["alnum"]} ELSE {LIMITS["base64"]} END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM hot),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, rnk) FILTER (WHERE rnk < 3) AS bs,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, rnk) AS spans FROM every GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
