"""Operator 3: scoring by a hierarchical Pitman-Yor language model, seated as Chinese restaurants by Gibbs sampling.

Every word is a context with a restaurant G_u of its own and a dish of its own; nothing is folded together:

    P(w | u) = (n(u, w) - d t(u, w)) / (s + n(u)) + (s + d t(u)) / (s + n(u)) * P(w)

n are customers and t tables.  All G_u share the parent restaurant G_0, whose customers are the tables of its children,
and which falls back to the uniform distribution of the known words and one unknown word.  A word that was no context
in training predicts by G_0.

Texts go through the cluster as blocks of a few MB, written once: the distinct words of a block and, for each token, the
number of its word there.  Pairs and words live in buckets by hash.  A block asks about its distinct pairs and words in
packed lists, one for each bucket, so a pair costs a few bytes and no row of its own, and a pair that is everywhere is
asked for once a block.  A bucket of pairs adds up the lists, knows which pairs repeat, and keeps these with their
seatings; buckets of pairs and of words send each other tables in packed lists, a round at a time, each step a written
table.  For scoring, the buckets answer the blocks' lists with n - d t of the pairs that repeat and with the seatings of
the words, and a block puts its tokens' probabilities together.  A pair of a training row that gets no answer was seen
once, in that row.  Blocks and buckets have fixed sizes, so a list has BLOCK_TOKENS * BUCKET_TOKENS / (all tokens) pairs;
both grow with the executors' memory.  Short numbers for frequent words (found in a sample of rows) save bytes and
change no score.

A pair seen once has one table.  Of all others every customer is seated anew in every round, with the tables of the
round before.  A dish of up to ``JOINT`` customers has all of them seated at once, its tables drawn from their exact law
given all other dishes: t tables weigh S(c, t) times the product over k < t of (s + d * (other tables + k)) * P(dish), S
being generalised Stirling numbers.  Of a dish with more customers the sizes of the tables are carried from round to
round, and a sweep of ``STEPS`` steps takes as many customers off their tables as it has and seats each again: at a
table by its size less the discount, or at a new one by (s + d * tables of the restaurant) * P(dish); those of a step
leave and come together.  Such a dish starts from the closed form expected_tables().  In a round the parent and the
other dishes' tables stand still; the parent then takes up what its children's tables have become and is swept in the
same way.  Random numbers are hashes of the pair, round and move, so where a row lies doesn't decide them.
Predictive probabilities are averaged over the rounds after the first; a text's perplexity is 10 ** (-score / tokens).

Null and empty texts have the end token alone.  Rows without doc_id are scored and never trained on.  Repeated rows
stay rows.  Without training rows the model is uniform.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sampling import fold
from .words import BASE, STEP, U, as_long, blocks, hash_bytes, mix, word_names

SHORTLIST = 1 << 17
END = U(hash_bytes(b"\n"))  # no word holds a line end
STRENGTH, JOINT, STEPS, ROUNDS = 1.0, 128, 32, 4
#: Tokens of a block and, about, of a bucket: what one task holds at once.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 18, 1 << 20


def tokens(b) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lower-cased words of each document with an end token behind, and their offsets."""
    names, to = word_names(b)
    return np.insert(names, to[1:], END), to + np.arange(len(to))


def contexts(h: np.ndarray, to: np.ndarray, end) -> np.ndarray:
    """The word before each token; before a document stands the end token."""
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[to[:-1]] = end
    return u


def pair_names(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * U(STEP) + w)


@dataclass
class Short:
    """Names of frequent words, sorted, and the numbers under SHORTLIST that stand for them, which take fewer bytes."""

    names: np.ndarray
    number: np.ndarray

    def encode(self, h: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return h
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, self.number[at], h)


def frequent(docs: DataFrame, rows: int = 20_000) -> Short:
    """Of a sample of the rows, since it decides bytes alone."""
    n = docs.count()

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(0)):
                w, count = np.unique(tokens(b)[0], return_counts=True)
                w, count = w[count > 1], count[count > 1]
                yield pa.RecordBatch.from_arrays([as_long(w), pa.array(count)], ["w", "n"])

    some = docs.select("text") if n <= rows else docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    words = some.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    names = _names(words.orderBy(F.desc("n"), "w").limit(SHORTLIST).select("w").toArrow()["w"])
    order = np.argsort(names)
    return Short(names[order], order.astype(U))


@functools.cache
def _zip():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as byte planes, of each column as many as its largest number needs, compressed unless
    short.  In front: whether it is, and the columns' planes."""
    widths = [max(1, (int(c.view(U).max()).bit_length() + 7) // 8) if len(c) else 1 for c in columns]
    raw = b"".join([c.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip((c.view(np.int64) for c in columns), widths, strict=True)])
    short = len(columns[0]) <= 32
    return bytes([short, *widths]) + (raw if short else _zip()[0].compress(raw))


def unpacked(raw: bytes, columns: int) -> np.ndarray:
    """What packed() took, a row a column."""
    widths, data = raw[1 : columns + 1], raw[columns + 1 :]
    x = np.frombuffer(data if raw[0] else _zip()[1].decompress(data), np.uint8).reshape(sum(widths), -1)
    out, at = np.zeros((columns, x.shape[1], 8), np.uint8), 0
    for i, w in enumerate(widths):
        out[i, :, :w] = x[at : at + w].T
        at += w
    return out.view(U)[:, :, 0]


def signed(x: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small numbers: 0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return (x << 1) ^ (x >> 63)


def unsigned(x: np.ndarray) -> np.ndarray:
    """What signed() took."""
    return (x >> 1) ^ -(x & 1)


BLOCK_KINDS = "block long, doc_id array<long>, trained array<boolean>, sizes array<int>, names array<long>, tokens binary"


def _list(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def as_blocks(docs: DataFrame, training, short) -> DataFrame:
    """Rows of about BLOCK_TOKENS tokens, in whole documents: names of the distinct words, the most frequent first, and
    the number of each token's word among them."""

    def run(batches):
        from pyspark import TaskContext

        first, nth, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def made() -> pa.RecordBatch:
            names, which, times = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, trained, sizes = (pa.concat_arrays([x[i] for x in held]) for i in (1, 2, 3))
            blob = pa.array([packed(rank[which])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([first + nth]), _list(ids), _list(trained), _list(sizes), _list(as_long(short.value.encode(names[order]))), blob], ["block", "doc_id", "trained", "sizes", "names", "tokens"])

        for batch in batches:
            for b in blocks(batch.column(1)):
                h, to = tokens(b)
                part = [batch.column(i).slice(b.first, b.n) for i in (0, 2)]
                held.append((h, *part, pa.array(np.diff(to).astype(np.int32))))
                n += len(h)
                if n >= BLOCK_TOKENS:
                    yield made()
                    held, n, nth = [], 0, nth + 1
        if held:
            yield made()

    mine = F.coalesce(training, F.lit(False)) & F.col("doc_id").isNotNull()
    return docs.select(F.col("doc_id").cast("long"), "text", mine.alias("trained")).mapInArrow(run, BLOCK_KINDS)


class Part:
    """A block: its words, and the word and the context of each token as numbers among these."""

    def __init__(self, row, short: Short):
        self.block, self.doc_id, self.names = row["block"].as_py(), row["doc_id"].values, _names(row["names"].values)
        self.sizes = np.asarray(row["sizes"].values).astype(np.int64)
        self.to = np.append(0, np.cumsum(self.sizes))
        self.w = unpacked(row["tokens"].as_py(), 1)[0].astype(np.int64)
        self.trained = np.repeat(np.asarray(row["trained"].values.to_numpy(zero_copy_only=False), bool), self.sizes)
        end = int(np.flatnonzero(self.names == short.encode(np.array([END]))[0])[0])
        self.u = np.empty_like(self.w)
        self.u[1:] = self.w[:-1]
        self.u[self.to[:-1]] = end

    def pairs(self, buckets: int):
        """(bucket, context, word) of the distinct pairs, in this order, where each bucket begins, the pair of each
        token."""
        by = np.argsort(self.names)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        key, inverse = np.unique(rank[self.u] * np.int64(len(by)) + rank[self.w], return_inverse=True)
        u, w = self.names[by][key // len(by)], self.names[by][key % len(by)]
        bucket = (pair_names(u, w) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return bucket[order], u[order], w[order], _begins(bucket[order]), place[inverse]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of a value begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def spread(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, where each bucket begins) of names sorted by bucket and name."""
    bucket = (mix(names) % U(buckets)).astype(np.int64)
    order = np.lexsort((names, bucket))
    return order, bucket[order], _begins(bucket[order])


def _cut(first: np.ndarray, n: int) -> list[slice]:
    return [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True)]


def _parts(batches, short: Short):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Part({k: batch.column(j)[i] for j, k in enumerate(batch.schema.names)}, short)


STATE, LIST, WANTED, TOTALS, ASKED = range(5)
#: Rows between buckets: a bucket's own state, a list from src to dst, which words a bucket of pairs asks for, sums, and
#: which seats a block asks for.
ROWS = "kind int, src long, dst long, x binary, y binary, v array<double>"
_ROWS = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("v", pa.list_(pa.float64()))])


def _rows(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)


def word_lists(parts: DataFrame, short, buckets: int) -> DataFrame:
    """ROWS: each block's distinct words in a bucket with their training tokens."""

    def run(batches):
        for p in _parts(batches, short.value):
            order, bucket, first = spread(p.names, buckets)
            n, names = np.bincount(p.w[p.trained], minlength=len(p.names))[order], p.names[order]
            yield from _rows([(LIST, p.block, int(bucket[c.start]), packed(np.diff(names[c], prepend=U(0)), n[c]), None, None) for c in _cut(first, len(names))]).to_batches()

    return parts.select("block", "doc_id", "trained", "sizes", "names", "tokens").mapInArrow(run, ROWS)


def asked(parts: DataFrame, short, buckets: int) -> DataFrame:
    """(block, bucket, pairs): each block's distinct pairs in a bucket, sorted, as packed contexts, words, and
    2 * training tokens + (1 if another row has the pair, too)."""

    def run(batches):
        for p in _parts(batches, short.value):
            bucket, u, w, first, place = p.pairs(buckets)
            mine = np.bincount(place, weights=p.trained, minlength=len(u)).astype(np.int64)
            more = np.bincount(place, minlength=len(u)) > mine
            blobs = [packed(np.diff(u[c], prepend=U(0)), w[c], (2 * mine + more)[c]) for c in _cut(first, len(u))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), p.block)), pa.array(bucket[first]), pa.array(blobs, pa.binary())], ["block", "bucket", "pairs"])

    return parts.mapInArrow(run, "block long, bucket long, pairs binary")


class Asked:
    """The lists of a bucket: all their pairs, and the distinct ones with their training tokens."""

    def __init__(self, table: pa.Table):
        lists = [unpacked(x, 3) for x in table["pairs"].to_pylist()]
        self.sizes = np.array([x.shape[1] for x in lists], np.int64)
        u, w, n = (np.concatenate([f(x) for x in lists]) for f in (lambda x: np.cumsum(x[0], dtype=U), lambda x: x[1], lambda x: x[2]))
        self.other = n % U(2) > 0
        n = (n // U(2)).astype(np.int64)
        name = pair_names(u, w)
        order = np.argsort(name)
        new = _begins(name[order])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        self.u, self.w, self.n = u[order[new]], w[order[new]], np.add.reduceat(n[order], new)


class Seats:
    """A bucket of pairs that repeat, in the order of their names: customers, tables, the sum of tables over the rounds
    that count, and the sizes of large dishes' tables."""

    def __init__(self, bucket: int, u, w, n, t, sum_t, cell, size):
        self.bucket, self.u, self.w, self.n, self.t, self.sum_t, self.cell, self.size = bucket, u, w, n, t, sum_t, cell, size

    @classmethod
    def of(cls, bucket: int, x: bytes, y: bytes) -> Seats:
        u, w, n, t, sum_t = unpacked(x, 5)
        return cls(bucket, u, w, *(k.view(np.int64) for k in (n, t, sum_t)), *(k.view(np.int64) for k in unpacked(y, 2)))

    def row(self) -> tuple:
        return STATE, self.bucket, self.bucket, packed(self.u, self.w, self.n, self.t, self.sum_t), packed(self.cell, self.size), None

    def words(self, buckets: int):
        """(words by bucket and name, buckets, where each begins, places of the contexts, places of the dishes)."""
        names, which = np.unique(np.append(self.u, self.w), return_inverse=True)
        order, bucket, first = spread(names, buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return names[order], bucket, first, place[which[: len(self.u)]], place[which[len(self.u) :]]


def _from(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pc.equal(table["kind"], kind)).select(["src", "dst", "x", "y"]).to_pylist()


def begin_pairs(buckets: int):
    """Lists of blocks to a bucket: to its seats, to what each list's places will be answered with (ASKED: place, number
    of the seat or 0 for a pair seen once that other rows have, too), and to the words, what repeated pairs there are:
    pairs and tokens by dish and by context.  Blocks below 0 get no answer."""

    def run(table: pa.Table) -> pa.Table:
        a = Asked(table)
        some = np.flatnonzero(a.n > 1)
        seat = np.zeros(len(a.n), np.int64)
        seat[some] = np.arange(1, len(some) + 1)
        wanted = (a.n[a.of] > 1) | (a.n[a.of] == 1) & a.other
        me, asks = table["bucket"][0].as_py(), []
        for block, at, n in zip(table["block"].to_pylist(), np.cumsum(a.sizes) - a.sizes, a.sizes, strict=True):
            here = np.flatnonzero(wanted[at : at + n])
            if len(here) and block >= 0:
                asks.append((ASKED, block, me, packed(np.diff(here, prepend=0), seat[a.of[at + here]]), None, None))
        if not len(some):
            return _rows(asks)
        none = np.zeros(0, np.int64)
        n = a.n[some]
        seats = Seats(me, a.u[some], a.w[some], n, np.ones_like(n), np.zeros_like(n), none, none)
        names, bucket, first, at_u, at_w = seats.words(buckets)
        sums = [np.bincount(at, weights=x, minlength=len(names)).astype(np.int64) for at in (at_w, at_u) for x in (None, n)]
        out = [(LIST, seats.bucket, int(bucket[c.start]), packed(np.diff(names[c], prepend=U(0)), *[x[c] for x in sums]), None, None) for c in _cut(first, len(names))]
        return _rows([seats.row(), (TOTALS, 0, 0, None, None, [float((n == 2).sum())]), *out, *asks])

    return run


#: What a word's state holds: name, customers as dish and as context, those of pairs seen once by dish and by context,
#: its children's tables, its restaurant's tables, its tables in the parent, and the latter three of each round that counts.
FIELDS = 7


def begin_words(rounds: int):
    """Block lists and lists of begin_pairs to a bucket's words, and the words each bucket of pairs asks for."""

    def run(table: pa.Table) -> pa.Table:
        lists = [(r["src"], unpacked(r["x"], 2)) for r in _from(table, LIST) if r["y"] is not None]
        asks = [(r["src"], unpacked(r["x"], 5)) for r in _from(table, LIST) if r["y"] is None]
        k, which = np.unique(np.concatenate([np.cumsum(x[0], dtype=U) for _, x in lists]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([x[1] for _, x in lists]).astype(float), minlength=len(k)).astype(np.int64)
        some = np.flatnonzero(n)
        k, n = k[some], n[some]
        sums, wanted = np.zeros((4, len(k)), np.int64), []
        for src, x in asks:
            at = np.searchsorted(k, np.cumsum(x[0], dtype=U))
            sums[:, at] += x[1:].view(np.int64)
            wanted.append((WANTED, src, table["dst"][0].as_py(), packed(np.diff(at, prepend=0)), None, None))
        if not len(k):
            return _rows([])
        mw, nw, mu, nu = sums
        x = np.zeros((FIELDS + 3 * rounds, len(k)), np.int64)
        x[0], x[1], x[2], x[3], x[4], x[5], x[6] = k.view(np.int64), n, n - nw, n - nu, n - nw + mw, n - nu + mu, 1
        none = np.zeros(0, np.int64)
        at = table["dst"][0].as_py()
        totals = [float(v) for v in (len(k), n.sum(), x[2].sum(), (x[4] == 1).sum(), (x[4] == 2).sum(), x[4].sum())]
        return _rows([(STATE, at, at, packed(*x), packed(none, none), None), (TOTALS, 0, 0, None, None, totals), *wanted])

    return run


def met_words(table: pa.Table, columns: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(state, dish and size of large dishes' tables, what buckets of pairs ask for) of a bucket of words, the tables of
    round r - 1 of the pairs taken in."""
    [own] = _from(table, STATE)
    x = unpacked(own["x"], columns).view(np.int64)
    cell, size = unpacked(own["y"], 2).view(np.int64)
    wanted = [(q["src"], np.cumsum(unpacked(q["x"], 1)[0].view(np.int64))) for q in _from(table, WANTED)]
    told = {q["src"]: q["x"] for q in _from(table, LIST)}
    if r:
        x[4], x[5] = x[2], x[3]
        for src, at in wanted:
            t = unpacked(told[src], 2).view(np.int64)
            x[4, at] += t[0]
            x[5, at] += t[1]
        if r > 1:
            x[FIELDS + 3 * (r - 2) + 2] = x[5]
    return x, cell, size, wanted


def seat_words(columns: int, d: float, base: float, tables: float, seed: int, r: int):
    """A round of the parent: state, lists of the round before and wants to state and lists for the pairs."""

    def run(table: pa.Table) -> pa.Table:
        x, cell, size, wanted = met_words(table, columns, r)
        now, t = x[4], x[6]
        same = lambda v: np.full(len(now), v)
        x[6], cell, size = reseat(now, t, cell, size, np.maximum(same(tables), t), same(base), d, _keys(x[0].view(U), seed, r))
        if r:
            x[FIELDS + 3 * (r - 1)], x[FIELDS + 3 * (r - 1) + 1] = now, x[6]
        at = table["dst"][0].as_py()
        totals = [float(v) for v in (x[6].sum(), now.sum(), (now == 1).sum(), (now == 2).sum())]
        out = [(LIST, at, src, packed(x[4, k], x[5, k], x[6, k]), None, None) for src, k in wanted]
        return _rows([(STATE, at, at, packed(*x), packed(cell, size), None), (TOTALS, 0, 0, None, None, totals), *out])

    return run


def seat_pairs(buckets: int, parent: tuple[float, float, float], d: float, seed: int, r: int):
    """A round of the pairs: seats and the words' lists to seats and lists for the words."""

    def run(table: pa.Table) -> pa.Table:
        [own] = _from(table, STATE)
        seats = Seats.of(own["src"], own["x"], own["y"])
        names, bucket, first, at_u, at_w = seats.words(buckets)
        cuts = dict(zip(bucket[first].tolist(), _cut(first, len(names)), strict=True))
        told = np.zeros((3, len(names)), np.int64)
        for q in _from(table, LIST):
            told[:, cuts[q["src"]]] = unpacked(q["x"], 3).view(np.int64)
        p, _ = backed(parent, d, told[0], told[2], told[1], told[1])
        seats.t, seats.cell, seats.size = reseat(seats.n, seats.t, seats.cell, seats.size, told[1][at_u], p[at_w], d, _keys(pair_names(seats.u, seats.w), seed, r))
        seats.sum_t = seats.sum_t + seats.t * (r > 0)
        tw, tu = (np.bincount(at, weights=seats.t, minlength=len(names)).astype(np.int64) for at in (at_w, at_u))
        return _rows([seats.row(), *[(LIST, seats.bucket, b, packed(tw[c], tu[c]), None, None) for b, c in cuts.items()]])

    return run


_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("pairs", pa.binary()), ("words", pa.binary())])
ANSWERS = "block long, bucket long, pairs binary, words binary"


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ANSWERS, strict=True)], schema=_ANSWERS)


def answer_pairs(rounds: int):
    """A bucket's seats and what blocks asked of it to ANSWERS: places in their lists, customers and the sum of tables
    over the rounds that count."""

    def run(table: pa.Table) -> pa.Table:
        n, sum_t = np.array([1]), np.array([rounds])
        for r in _from(table, STATE):
            seats = Seats.of(r["src"], r["x"], r["y"])
            n, sum_t = np.append(n, seats.n), np.append(sum_t, seats.sum_t)
        out = []
        for r in _from(table, ASKED):
            x = unpacked(r["x"], 2).view(np.int64)
            out.append((r["src"], r["dst"], packed(x[0], n[x[1]], sum_t[x[1]]), None))
        return _answers(out)

    return run


def _before(x: np.ndarray) -> np.ndarray:
    """What the rows behind the first are likely to be, by rows above: the same of the round before; in the first round
    n for the children's tables and the own restaurant's, and no table in the parent."""
    out = np.zeros_like(x[1:])
    out[3:] = x[1:-3]
    out[0] = out[2] = x[0]
    return out


def answer_words(columns: int, rounds: int):
    """Lists of blocks and a bucket of words to the same: n and the seatings of each round of the words asked for."""

    def run(table: pa.Table, asks: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _answers([])
        x = met_words(table, columns, rounds + 1)[0] if table.num_rows else np.zeros((columns, 0), np.int64)
        k, out = x[0].view(U), []
        for q in asks.to_pylist():
            names = np.cumsum(unpacked(q["x"], 2)[0], dtype=U)
            at = np.minimum(np.searchsorted(k, names), max(len(k) - 1, 0))
            known = k[at] == names if len(k) else np.zeros(len(names), bool)
            told = np.zeros((1 + 3 * rounds, len(names)), np.int64)
            told[:, known] = x[[1, *range(FIELDS, columns)]][:, at[known]]
            out.append((q["src"], q["dst"], None, packed(told[0], *signed(told[1:] - _before(told)))))
        return _answers(out)

    return run


def expected_tables(c: np.ndarray, fresh: np.ndarray, d: float, steps: int = 48) -> np.ndarray:
    """About how many tables c customers of a dish take, if a new one weighs ``fresh``: where the sampler starts."""
    t, j = np.ones(len(c)), np.ones(len(c))
    for k in range(1, steps + 1):
        to = c.astype(float) ** (k / steps)
        t = np.minimum(t + (to - j) * fresh / (fresh + np.maximum(j - d * t, 1e-9)), to)
        j = to
    return np.clip(np.rint(t), 1, c).astype(np.int64)


def start(c: np.ndarray, fresh: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(dish, size) of the tables the sampler starts from."""
    t = expected_tables(c, fresh, d)
    size = np.ones(int(t.sum()), np.int64)
    size[np.cumsum(t) - t] = c - (t - 1)
    return np.repeat(np.arange(len(c)), t), size


def drawn(key: np.ndarray, nth: np.ndarray, salt: int) -> np.ndarray:
    """A number from [0, 1) for each name, customer and step."""
    more = mix((nth.astype(U) << U(8)) + U(salt)) * U(BASE)
    return (mix(key + more) >> U(11)).astype(float) * 2.0**-53


def moved(cell: np.ndarray, size: np.ndarray, out: np.ndarray, into: np.ndarray, rest: np.ndarray, base: np.ndarray, d: float, key: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(dish, size) of the tables after ``out`` customers of each dish left and ``into`` were seated; rest: tables of
    the other dishes in the restaurant, base: the dish's probability in the parent."""
    m = len(out)
    own = np.bincount(cell, weights=size, minlength=m).astype(np.int64)
    who = np.repeat(np.arange(m), out)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(out) - out, out)
    low, high = nth * own[who] // out[who], (nth + 1) * own[who] // out[who]  # one customer of each stratum: no one twice
    at = np.searchsorted(np.cumsum(size), (np.cumsum(own) - own)[who] + low + np.floor(drawn(key[who], nth, 2 * step) * (high - low)).astype(np.int64), side="right")
    size = size - np.bincount(at, minlength=len(size))
    cell, size = cell[size > 0], size[size > 0]
    t = np.bincount(cell, minlength=m)
    upto = np.append(0.0, np.cumsum(size - d))
    last = np.cumsum(t)
    first = last - t
    pull, new = upto[last] - upto[first], (STRENGTH + d * (rest + t)) * base
    who = np.repeat(np.arange(m), into)
    y = drawn(key[who], np.arange(len(who)) - np.repeat(np.cumsum(into) - into, into), 2 * step + 1) * (pull + new)[who]
    opens = (y < new[who]) | (t[who] == 0)
    stays = who[~opens]
    pick = np.searchsorted(upto[1:], upto[first[stays]] + y[~opens] - new[stays], side="left")
    size = size + np.bincount(np.clip(pick, first[stays], last[stays] - 1), minlength=len(size))
    cell, size = np.append(cell, who[opens]), np.append(size, np.ones(int(opens.sum()), np.int64))
    order = np.argsort(cell, kind="stable")
    return cell[order], size[order]


def sweep(c: np.ndarray, cell: np.ndarray, size: np.ndarray, rest: np.ndarray, base: np.ndarray, d: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dish, size) of the tables after as many Gibbs moves of each dish as it has customers (none if only one)."""
    by = np.argsort(-c, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[by] = np.arange(len(c))
    order = np.argsort(rank[cell], kind="stable")
    cell, size, c, rest, base, key = rank[cell][order], size[order], c[by], rest[by], base[by], key[by]
    for k in range(min(STEPS, int(c.max(initial=0)))):
        n = int(np.searchsorted(-c, -max(k, 1), side="left"))  # dishes of more customers, which come first
        parts = np.minimum(c[:n], STEPS)
        q = (k + 1) * c[:n] // parts - k * c[:n] // parts
        cut = int(np.searchsorted(cell, n))
        a, b = moved(cell[:cut], size[:cut], q, q, rest[:n], base[:n], d, key[:n], k)
        cell, size = np.append(a, cell[cut:]), np.append(b, size[cut:])
    cell = by[cell]
    order = np.argsort(cell, kind="stable")
    return cell[order], size[order]


@functools.cache
def log_stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) of discount d for c, t up to JOINT."""
    out = np.full((JOINT + 1, JOINT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(JOINT):
        t = np.arange(1, c + 2)
        more = np.append(out[c, 1 : c + 1] + np.log(np.maximum(c - d * t[:-1], 1e-300)), -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], more)
    return out


def joint(c: np.ndarray, rest: np.ndarray, base: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn from their exact law given the rest; c is JOINT at the most."""
    if not len(c):
        return np.zeros(0, np.int64)
    to = np.cumsum(c)
    first = to - c
    which = np.repeat(np.arange(len(c)), c)
    k = np.arange(int(to[-1])) - first[which]
    new = np.cumsum(np.log((STRENGTH + d * (rest[which] + k)) * base[which]))
    value = log_stirling(d)[c[which], k + 1] + new - new[first][which]
    upto = np.append(0.0, np.cumsum(np.exp(value - np.maximum.reduceat(value, first)[which])))
    y = upto[first] + drawn(key, np.zeros(len(c), np.int64), 255) * (upto[to] - upto[first])
    return np.clip(np.searchsorted(upto[1:], y, side="right"), first, to - 1) - first + 1


def reseat(c: np.ndarray, t: np.ndarray, cell: np.ndarray, size: np.ndarray, total: np.ndarray, base: np.ndarray, d: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables of each dish, dish and size of the tables of large dishes) after a round; t: tables before it, cell and
    size: those of large dishes, which may have gained or lost customers, total: tables of each dish's restaurant."""
    t = t.copy()
    few, some = c <= JOINT, (c <= JOINT) & (c > 1)  # one customer has one table
    t[c == 1] = 1
    t[some] = joint(c[some], (total - t)[some], base[some], d, key[some])
    many = np.flatnonzero(~few)
    if not len(many):
        return t, np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, rest, base, key = c[many], (total - t)[many], base[many], key[many]
    own = ~few[cell]
    cell, size = np.searchsorted(many, cell[own]), size[own]
    were = np.bincount(cell, weights=size, minlength=len(c)).astype(np.int64)
    fresh = np.flatnonzero(were == 0)
    a, b = start(c[fresh], (STRENGTH + d * total[many[fresh]]) * base[fresh], d)
    were[fresh] = c[fresh]
    cell, size = np.append(cell, fresh[a]), np.append(size, b)
    order = np.argsort(cell, kind="stable")
    cell, size = moved(cell[order], size[order], np.maximum(were - c, 0), np.maximum(c - were, 0), rest, base, d, key, STEPS)
    cell, size = sweep(c, cell, size, rest, base, d, key)
    t[many] = np.bincount(cell, minlength=len(c))
    return t, many[cell], size


def discount(once: float, twice: float) -> float:
    """From how many kinds were seen once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once + twice else 0.5


def _names(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(U)


def _keys(names: np.ndarray, seed: int, r: int) -> np.ndarray:
    return mix(names + U(mix(np.array([seed * 1000 + r], U))[0]))


def backed(parent: tuple[float, float, float], d: float, now: np.ndarray, t: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parent's probability of words, the weight their own restaurants give the parent) after a round; now: tables
    of the children, t: tables in the parent, total: tables in the own restaurant, n: customers there."""
    d0, customers, empty = parent
    return (now - d0 * t) / (STRENGTH + customers) + empty, (STRENGTH + d * total) / (STRENGTH + n)


def expected(states: DataFrame, columns: int, d: float, kinds: int) -> float:
    """Tables of the parent where the sampler starts, when it has ``kinds`` dishes."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                c = unpacked(x, columns)[4].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([float(expected_tables(c, np.full(len(c), (STRENGTH + d * kinds) / (kinds + 1)), d).sum())])], ["t"])

    return states.select("x").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0


class LanguageModel:
    """Blocks, lists and the buckets' states in written tables; a few totals on the driver."""

    def __init__(self, docs: DataFrame, training, seed: int = 3):
        spark = self.spark = docs.sparkSession
        self.docs, self.folder = docs, store.scratch(spark, "lm")
        self.rounds, self.columns = ROUNDS - 1, FIELDS + 3 * (ROUNDS - 1)
        self.short = spark.sparkContext.broadcast(frequent(docs))
        self.parts = store.written(as_blocks(docs, training, self.short), f"{self.folder}/blocks")
        some = self.parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        self.buckets = max(8, -(-some // BUCKET_TOKENS))
        pairs = self._begun(asked(self.parts, self.short, self.buckets), f"{self.folder}/pairs")
        self.asked = self._of(pairs, ASKED)
        store.tidy(spark)
        theirs = word_lists(self.parts, self.short, self.buckets).withColumn("y", F.lit(b""))
        words = self._step(theirs.unionByName(self._of(pairs, LIST)), begin_words(self.rounds), f"{self.folder}/words")
        self.wanted = self._of(words, WANTED)
        self.v, self.n, once, one, two, customers = self._totals(words, 6)
        self.d, d0 = discount(once, self._totals(pairs, 1)[0]), discount(one, two)
        tables = expected(self._of(words, STATE), self.columns, d0, self.v)
        base, lists, old = 1.0 / (self.v + 1), self._of(pairs, LIST).limit(0), []
        self.parents = []  # of each round that counts: discount, customers and what an unknown dish gets
        store.tidy(spark)
        for r in range(ROUNDS):
            words = self._step(self._of(words, STATE).unionByName(self.wanted).unionByName(lists), seat_words(self.columns, d0, base, tables, seed, r), f"{self.folder}/words-{r}")
            tables, customers, one, two = self._totals(words, 4)
            parent = (d0, customers, (STRENGTH + d0 * tables) * base / (STRENGTH + customers))
            pairs = self._step(self._of(pairs, STATE).unionByName(self._of(words, LIST)), seat_pairs(self.buckets, parent, self.d, seed, r), f"{self.folder}/seats-{r}")
            lists = self._of(pairs, LIST)
            self.parents += [parent] * (r > 0)
            d0 = discount(one, two)
            for x in old:
                store.remove(spark, x)
            old = [f"{self.folder}/words-{r}", f"{self.folder}/seats-{r}"]
            store.tidy(spark)
        for x in ("words", "pairs"):  # where the sampler started; what was asked stays
            for kind in (STATE, LIST):
                store.remove(spark, f"{self.folder}/{x}/kind={kind}")
        self.seats, self.words, self.told = self._of(pairs, STATE), self._of(words, STATE), lists

    def _begun(self, lists: DataFrame, path: str) -> DataFrame:
        return self._stepped(lists.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(begin_pairs(self.buckets), ROWS), path)

    def _stepped(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.partitionBy("kind").parquet(path)
        return self.spark.read.schema(ROWS).parquet(path)

    def _step(self, rows: DataFrame, run, path: str) -> DataFrame:
        """What every bucket makes of the rows for it, written."""
        return self._stepped(rows.repartition(self.buckets, "dst").groupBy("dst").applyInArrow(run, ROWS), path)

    @staticmethod
    def _of(rows: DataFrame, kind: int) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("kind", "src", "dst", "x", "y", "v")

    def _totals(self, rows: DataFrame, n: int) -> list:
        """Sums over the buckets."""
        return [x or 0 for x in self._of(rows, TOTALS).agg(*[F.sum(F.col("v")[i]) for i in range(n)]).first()]

    def score(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Without ``keep`` the model's tables go once the blocks have their answers, so this is its last use.

        Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.  Of the table that the model
        was made of, each row is scored as what it was there, trained on or not; rows of others never were."""
        short, k, d, buckets = self.short, self.rounds, self.d, self.buckets
        parts, asked_, folder = self.parts, self.asked, store.scratch(self.spark, "lm-score")
        if docs is not self.docs:
            parts = store.written(as_blocks(docs, F.lit(False), short), f"{folder}/blocks")
            both = asked(self.parts, short, buckets).withColumn("block", F.lit(-1).cast("long")).unionByName(asked(parts, short, buckets))
            asked_ = self._of(self._begun(both, f"{folder}/pairs"), ASKED)  # the same pairs repeat, so seats have the same numbers
        dealt = lambda x, by: x.repartition(buckets, by).groupBy(by)
        met = dealt(self.seats.unionByName(asked_), "dst").applyInArrow(answer_pairs(k), ANSWERS)
        asks = word_lists(parts, short, buckets).select("src", "dst", "x")
        state = self.words.unionByName(self.wanted).unionByName(self.told)
        known = dealt(state, "dst").cogroup(dealt(asks.withColumnRenamed("dst", "to").withColumn("dst", F.col("to")), "to")).applyInArrow(answer_words(self.columns, k), ANSWERS)
        # Written, so that the lists' shuffles are gone before the blocks are dealt out.
        met = store.written(met, f"{folder}/met")
        store.tidy(self.spark)
        known = store.written(known, f"{folder}/known")
        del asked_, asks, state
        if not keep:
            for x in ("words", "pairs", f"words-{ROUNDS - 1}", f"seats-{ROUNDS - 1}"):
                store.remove(self.spark, f"{self.folder}/{x}")
            self.asked = self.wanted = self.seats = self.words = self.told = None
        store.tidy(self.spark)
        parents, uniform = self.parents, float(np.log10(self.n + self.v + 1))

        def run(table: pa.Table) -> pa.Table:
            whole = table.filter(pc.is_valid(table["names"])).combine_chunks()
            p = Part({name: whole[name][0] for name in ("block", "doc_id", "trained", "sizes", "names", "tokens")}, short.value)
            order, bucket, first = spread(p.names, buckets)
            cuts = dict(zip(bucket[first].tolist(), _cut(first, len(order)), strict=True))
            told = table.filter(pc.is_valid(table["words"]))
            x = np.zeros((1 + 3 * k, len(order)), np.int64)
            for b, raw in zip(told["bucket"].to_pylist(), told["words"].to_pylist(), strict=True):
                y = unpacked(raw, 1 + 3 * k).view(np.int64)
                y[1:] = unsigned(y[1:])
                for i in range(k):
                    y[1 + 3 * i : 4 + 3 * i] += y[3 * i - 2 : 3 * i + 1] if i else np.stack([y[0], np.zeros_like(y[0]), y[0]])
                x[:, order[cuts[b]]] = y
            n, parent = x[0], np.zeros(len(p.w))
            for i in range(k):
                next_, back = backed(parents[i], d, *x[[1 + 3 * i, 2 + 3 * i, 3 + 3 * i]], n)  # of an unknown word: the empty share, 1
                parent += back[p.u] * next_[p.w] / k
            bucket, u, _, first, which = p.pairs(buckets)
            customers = np.zeros(len(u))
            told = table.filter(pc.is_valid(table["pairs"]))
            begin = dict(zip(bucket[first].tolist(), first.tolist(), strict=True))
            for b, raw in zip(told["bucket"].to_pylist(), told["pairs"].to_pylist(), strict=True):
                y = unpacked(raw, 3).view(np.int64)
                customers[begin[b] + np.cumsum(y[0])] = y[1] - d * y[2] / k
            own = customers[which]
            own = np.where(p.trained & (own == 0), 1.0 - d, own) / (STRENGTH + n[p.u])
            total = lambda v: np.add.reduceat(v, p.to[:-1])
            score, base = total(np.log10(own + parent)), total(np.log10(n[p.w] + 1.0)) - p.sizes * uniform
            return pa.table(
                [p.doc_id, pa.array(p.sizes), pa.array(total((n[p.w] > 0).astype(np.int64))), pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(-score / p.sizes, 300.0))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

        rows = parts.unionByName(met, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
        many = max(8, -(-int(parts.count()) // 2))
        out = rows.repartition(many, "block").groupBy("block").applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
        return out.select("doc_id", "n_tokens", "n_known", F.lit(int(self.n)).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = LanguageModel(docs, fold("doc_id", 7) != 2).score(docs, keep=False)
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
