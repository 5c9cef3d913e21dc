"""Operator 13: runs of repeated words, by Lyndon words instead of a suffix array.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.  Wanted are runs of
LEAST_WORDS words and of LEAST_POWER periods at least.

1. A word of such a run occurs LEAST_POWER times in it.  So words that occur more rarely in their document can't lie in
   a run; they cut it into stretches, whose words must occur so often in their own stretch, and so on.  These rounds
   are NumPy passes over many documents, lose no run, and leave little but repeated text.
2. The longest Lyndon word at each place of a stretch ends where the next smaller suffix starts.  A scan from right to
   left finds that place by a stack (each place leads on to the end of its own Lyndon word), once under an order of the
   words and once under its reverse.  Every run has a period that is one of these words.
3. Suffixes are compared, and periods extended to both sides, by the length of their common extension: binary search
   over rolling hashes modulo 2**61 - 1, then the words themselves are compared.  A known extension at the same
   distance is carried on, so that long repeats are compared once.

Null texts and texts without words have no run and collapse to an empty text.  Rows stay as they are, in any number,
also those without doc_id; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import STEP, U, blocks, mix, word_names

LEAST_WORDS, LEAST_POWER = 6, 4
PRIME, RADIX = (1 << 61) - 1, 0x9E3779B97F4A7C1

_powers = [1]


class Extensions:
    """Common extensions of places of a list of numbers, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.raw = np.array(words, np.int64).tobytes()
        self.sums = list(accumulate(words, lambda h, w: (h * RADIX + w + 1) % PRIME, initial=0))
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * RADIX % PRIME)
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, n: int) -> bool:
        """Hashes of n words at i and j are equal."""
        s, p = self.sums, _powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _same(self, i: int, j: int, n: int) -> bool:
        """n words at i and j are equal, word by word."""
        return self.raw[8 * i : 8 * (i + n)] == self.raw[8 * j : 8 * (j + n)]

    def _first(self, i: int, j: int, most: int) -> int:
        """Length of the common extension of i and j to the right, most at the most."""
        w = self.words
        for k in range(min(4, most)):
            if w[i + k] != w[j + k]:
                return k
        low, high = min(4, most), most
        step = 8
        while low < high:  # gallop, then halve
            mid = min(high, low + step) if step else (low + high + 1) // 2
            if self._alike(i, j, mid):
                low, step = mid, 2 * step
            else:
                high, step = mid - 1, 0
        if self._same(i, j, low) and (low == most or w[i + low] != w[j + low]):
            return low
        differ = np.frombuffer(self.raw, np.int64)  # a hash has lied
        at = np.flatnonzero(differ[i : i + most] != differ[j : j + most])
        return int(at[0]) if len(at) else most

    def right(self, i: int, j: int) -> int:
        """How many words from i < j on equal those from j on."""
        most, known = self.n - j, self.known.get(j - i)
        if known and known[0] >= i:
            gap = known[0] - i
            out = self._first(i, j, gap) if gap else 0
            if out == gap:
                out += known[1]
        else:
            out = self._first(i, j, most)
        self.known[j - i] = i, out
        return out

    def left(self, i: int, j: int, most: int) -> int:
        """How many words before i < j equal those before j, most at the most."""
        w, low, high = self.words, 0, min(most, i)
        if not high or w[i - 1] != w[j - 1]:
            return 0
        while low < high:
            mid = (low + high + 1) // 2
            if self._alike(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        if self._same(i - low, j - low, low) and (low == min(most, i) or w[i - low - 1] != w[j - low - 1]):
            return low
        n = 0
        while n < min(most, i) and w[i - n - 1] == w[j - n - 1]:
            n += 1
        return n


def lyndon_runs(words: list[int], least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> set[tuple[int, int, int]]:
    """(start, length, period) of the wanted runs of a list of numbers."""
    found, n = set(), len(words)
    both = Extensions(words)
    for w in (words, [-x for x in words]):
        end = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            a, j, same = w[i], i + 1, 0
            while j < n:
                b = w[j]
                if a == b:
                    same = both.right(i, j)
                    if j + same == n or w[i + same] > w[j + same]:
                        break
                elif a > b:
                    same = 0
                    break
                j, same = end[j], 0
            end[i] = j
            q = j - i
            least = max(least_words, least_power * q)
            # Of the places of a run that start its period, the first has less than a period before it.
            if same and same + 2 * q > least:
                before = both.left(i, j, q)
                if before < q and before + q + same >= least:
                    found.add((i - before, before + q + same, q))
    return found


def stretches(names: np.ndarray, doc: np.ndarray, least_words: int, least_power: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, last words + 1) of the stretches that may hold wanted runs."""
    at, part = np.arange(len(names)), doc.astype(U)
    while len(at):
        _, inverse, counts = np.unique(mix(names[at] + mix(part + U(1)) * U(STEP)), return_inverse=True, return_counts=True)
        often = counts[inverse] >= least_power
        at = at[often]
        starts = np.ones(len(at), bool)
        starts[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
        part = np.cumsum(starts)
        long = np.bincount(part, minlength=1)[part] >= least_words
        if often.all() and long.all():
            first = np.flatnonzero(starts)
            return at[first], at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else at
        at, part = at[long], part[long].astype(U)
    return at, at


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words
    that no run contains after its first period, joined by one space)."""
    if least_words < 2 or least_power < 2:
        raise ValueError("a run has two words and two periods at least")

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                names, to = word_names(b, lower=False)
                doc = np.repeat(np.arange(b.n), np.diff(to))
                raw = b.data.tobytes()
                per: dict[int, set] = {}
                split: dict[int, list[bytes]] = {}
                for x, y in zip(*(a.tolist() for a in stretches(names, doc, least_words, least_power)), strict=True):
                    d = int(doc[x])
                    if d not in split:
                        split[d] = raw[b.offsets[d] : b.offsets[d + 1]].split()
                    start = x - int(to[d])
                    number: dict[bytes, int] = {}
                    words = [number.setdefault(w, len(number)) for w in split[d][start : start + y - x]]
                    if runs := lyndon_runs(words, least_words, least_power):
                        per.setdefault(d, set()).update((s + start, n, q) for s, n, q in runs)
                collapsed, sizes, flat = [], np.zeros(b.n + 1, np.int32), []
                for d in range(b.n):
                    words = split.get(d) or raw[b.offsets[d] : b.offsets[d + 1]].split()
                    if d in per:
                        runs = sorted(per[d], key=lambda r: (r[0], r[2]))
                        flat += runs
                        sizes[d + 1] = len(runs)
                        kept = np.ones(len(words), bool)
                        for s, n, q in runs:
                            kept[s + q : s + n] = False
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    collapsed.append(b" ".join(words))
                columns = np.array(flat, np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(columns[:, c]) for c in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(np.diff(to).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), fields), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; a tenth of the texts, chosen by a hash of doc_id, repeat a stretch of their words to their end."""
    h = "crc32(CAST(doc_id AS string))"
    words = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text", f"{h} div 10 AS g", rf"IF({h} % 10 = 0, filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> ''), NULL) AS words")
    placed = words.selectExpr("*", "nullif(size(words), 0) AS n").selectExpr("*", "g % n AS a")
    placed = placed.selectExpr("*", "1 + (n - a) div (3 + g % 8) AS p")
    repeated = "concat_ws(' ', transform(words, (x, i) -> IF(i < a, x, words[CAST(a + (i - a) % p AS int)])))"
    return placed.selectExpr("doc_id", f"IF(words IS NOT NULL AND n > 0, {repeated}, text) AS text")


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    found = periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS at, -r.period AS q)))")
    lines = F.expr(r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    picked = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return picked.select(
        "doc_id", "n_runs", (-F.col("b.at")).alias("start"), "b.length", (-F.col("b.q")).alias("period"),
        F.expr("1000 * b.length div -b.q").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
