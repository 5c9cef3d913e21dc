"""Text expressions: every one is a Column built from Spark's own functions.

A null text counts as empty everywhere: no tokens, an empty summary, and the id of the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Python's str.split and str.strip.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that carry no topic.
STOPWORDS = """a an and are as at be but by for from had has have he her his i if in is it its
me my no not of on or our she that the their them then there these they this to was
we were what when which who will with you your""".split()
SUMMARY, GIST, SKETCH = 160, 64, 8


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def keywords(c: Column) -> Column:
    """Tokens that are no stopwords, repeats kept; the first four tokens if none is left."""
    t = tokens(c)
    kept = F.filter(t, lambda x: ~x.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(t, 1, 4))


_SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(c: Column) -> Column:
    """Without white space at its ends; reads only the ends, whatever runs of blanks lie between."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_SPACES))


def collapsed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}++", " "), F.lit(" "))


def identity(c: Column) -> Column:
    """Names a trimmed text, so that groups by text don't deal out the texts."""
    return F.md5(trimmed(c).cast("binary"))


def own(c: Column) -> Column:
    """Names what near-duplicate identity takes as one text: its tokens, or a trimmed text without tokens itself; null
    without text."""
    body, normal = trimmed(c), normalized(c)
    return F.when(body != "", F.md5(F.when(normal != "", normal).otherwise(F.concat(F.lit("\n"), body)).cast("binary")))


def shortened(flat: Column, limit: int) -> Column:
    return F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))


def summary(c: Column, limit: int = SUMMARY) -> Column:
    """The text if it fits, else its first sentence if that ends in the limit, else a cut with an ellipsis."""
    flat = collapsed(c)
    at = F.regexp_instr(flat, F.lit("[.!?]"))
    return F.when(F.length(flat) <= limit, flat).when((at > 1) & (at <= limit + 1), F.substring(flat, F.lit(1), at)).otherwise(shortened(flat, limit))


def gist(c: Column) -> Column:
    return summary(c, GIST)


def downgraded(c: Column, limit: int) -> Column:
    flat = collapsed(c)
    if limit <= 0:
        return F.lit("")
    cut = F.substring(flat, 1, limit) if limit <= 3 else shortened(flat, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def sketch(c: Column) -> Column:
    """The smallest CRC-32 values of the keywords."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(keywords(c), lambda x: F.crc32(x.cast("binary"))))), 1, SKETCH)


def content_id(c: Column) -> Column:
    return F.concat(F.lit("m-"), F.substring(F.sha1(normalized(c).cast("binary")), 1, 10))
