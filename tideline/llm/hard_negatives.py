"""Operator 12: hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are whole numbers.  With M the largest norm, each row x gets one more coordinate, sqrt(M**2 - |x|**2), and an
anchor q gets 0 there.  Then |q - x|**2 = |q|**2 + M**2 - 2 * (q, x): higher scores are nearer rows, and a window of
scores is an annulus of distances, so trees of a metric answer it.  Bounds come from distances, results from exact
whole-number scores.

1. An upper tree is fitted on a bounded sample (SAMPLE rows) and gives each of all rows a cell.  Its rule of descent
   (inside the radius or not) bounds every row's distance, in the sample or not.  A cell with more than SHARD rows is
   dealt out to several shards by a hash of vec_id.  Of rows with equal vector and label only the smallest vec_ids that
   an answer can need are stored, which loses nothing and leaves no hot cell.
2. Each shard holds a vantage-point tree of its rows, in one binary value.
3. Blocks of QUERIES anchors meet the shards of their nearest cell first.  That gives each window an outer distance,
   and a second pass visits only shards of other cells that reach into the annulus within it.  In a shard, a query
   takes nodes nearest first, passes over those that lie outside its annulus, and stops at the first that is farther
   than its k-th answer.
4. The first k of all shards' answers are taken by anchor and window.

Searching runs twice: for the positives (rows of the anchor's label, no window), then for negatives (rows of other
labels, a window for each positive).

Rows with a null vec_id or label, a null vector, or any null or non-finite component take no part.  Of rows that repeat
a vec_id one counts: the smallest by label, then vector.  Shorter vectors count as filled up with zeros.  Scores beyond
62 bits raise an error.  Without anchors, positives or negatives there are no rows; an empty table gives none.  Other
columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .sampling import drawn

SAMPLE, MOST_CELLS, SHARD, LEAF, QUERIES = 4096, 256, 16384, 128, 256
#: Relative room for rounding in distances, which only decide what is visited.
ROOM = 1e-9

ROWS = "vec_id long, label long, v array<long>"


def whole_vectors(table: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, components floor(scale * x)."""
    fit = f"vec_id IS NOT NULL AND label IS NOT NULL AND {vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = table.where(fit).selectExpr("CAST(vec_id AS long) AS vec_id", "CAST(label AS long) AS label", f"transform({vector}, x -> floor({scale} * CAST(x AS double))) AS v")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of numbers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def augmented(x: np.ndarray, norm2: int) -> np.ndarray:
    """Rows with their further coordinate."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(axis=1)))])


def distances(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - p) ** 2).sum(axis=1))


@dataclass
class Upper:
    """The upper tree as a heap: nodes 1 .. cells - 1 with vantage points and radii, below them the cells."""

    points: np.ndarray
    radii: np.ndarray
    norm2: int

    @property
    def cells(self) -> int:
        return len(self.radii)

    @staticmethod
    def fitted(sample: np.ndarray, cells: int, norm2: int) -> Upper:
        """cells: a power of two. Vantage points are the rows farthest from the first of their part."""
        a = augmented(sample, norm2)
        points, radii = np.zeros((cells, a.shape[1])), np.zeros(cells)
        parts = {1: np.arange(len(a))}
        for node in range(1, cells):
            at = parts.pop(node)
            if len(at):
                points[node] = a[at[np.argmax(distances(a[at], a[at[0]]))]]
                d = distances(a[at], points[node])
                radii[node] = np.median(d)
                inside = d <= radii[node]
                parts[2 * node], parts[2 * node + 1] = at[inside], at[~inside]
            else:
                parts[2 * node] = parts[2 * node + 1] = at
        return Upper(points, radii, norm2)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Of each row."""
        a, node = augmented(x, self.norm2), np.ones(len(x), np.int64)
        for _ in range(self.cells.bit_length() - 1):
            d = np.sqrt(((a - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + (d > self.radii[node])
        return node - self.cells

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) distances from an anchor to rows of each cell."""
        d = distances(np.append(q.astype(np.float64), 0.0)[None, :], self.points)
        least, most = np.zeros(2 * self.cells), np.full(2 * self.cells, np.inf)
        for node in range(1, self.cells):
            i, o = 2 * node, 2 * node + 1
            least[i], most[i] = max(least[node], d[node] - self.radii[node]), min(most[node], d[node] + self.radii[node])
            least[o], most[o] = max(least[node], self.radii[node] - d[node]), most[node]
        return least[self.cells :], most[self.cells :]


class Shard:
    """A vantage-point tree of some rows, which are in the order of its leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norm2: int):
        self.norm2 = norm2
        a = augmented(v, norm2)
        order = np.arange(len(ids))
        #: Inner and outer child, first row, last + 1, vantage point (-1: a leaf), least and largest distance from it, of
        #: the inner and of the outer child.
        self.nodes: list[list] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = me
            self.nodes.append([0, 0, lo, hi, -1, 0.0, 0.0, 0.0, 0.0])
            if hi - lo <= LEAF:
                continue
            at = order[lo:hi]
            point = int(at[np.argmax(distances(a[at], a[at[0]]))])
            d = distances(a[at], a[point])
            ranked = np.argsort(d, kind="stable")
            if d[ranked[0]] == d[ranked[-1]]:
                continue  # all at one place
            order[lo:hi], d = at[ranked], d[ranked]
            mid = (hi - lo) // 2
            self.nodes[me][4:] = [point, d[0], d[mid - 1], d[mid], d[-1]]
            todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        place = np.argsort(order)
        for x in self.nodes:
            x[4] = int(place[x[4]]) if x[4] >= 0 else -1
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]

    def packed(self) -> bytes:
        """All of it, in the smallest whole-number type that holds the vectors."""
        kind = np.min_scalar_type(-int(np.abs(self.v).max(initial=1)) - 1)
        head = np.array([len(self.ids), self.v.shape[1] if len(self.ids) else 0, kind.itemsize, len(self.nodes)], np.int64)
        return b"".join([head.tobytes(), self.ids.tobytes(), self.labels.tobytes(), np.array(self.nodes, np.float64).tobytes(), self.v.astype(kind).tobytes()])

    @staticmethod
    def unpacked(raw: bytes, norm2: int) -> Shard:
        n, width, size, nodes = np.frombuffer(raw, np.int64, 4).tolist()
        out, at = Shard.__new__(Shard), 32
        out.norm2 = norm2
        out.ids, out.labels = np.frombuffer(raw, np.int64, n, at), np.frombuffer(raw, np.int64, n, at + 8 * n)
        at += 16 * n
        out.nodes = np.frombuffer(raw, np.float64, 9 * nodes, at).reshape(nodes, 9).tolist()
        at += 72 * nodes
        # Products of doubles are exact as long as no sum reaches 2**53.
        out.v = np.frombuffer(raw, np.dtype(f"i{size}"), n * width, at).reshape(n, width).astype(np.float64 if norm2 < 1 << 52 else np.int64)
        return out

    def search(self, q: np.ndarray, anchor: int, label: int, same: bool, windows: list[Wanted]) -> None:
        """Fill the windows with rows of the anchor's label (same) or of others; distances decide what is visited."""
        base = float(q @ q) + self.norm2
        far = lambda s: max(0.0, base - 2.0 * s) ** 0.5
        rim = ROOM * base**0.5 + 1e-6
        q = q.astype(self.v.dtype)
        heap, turn = [(0.0, 0, 0, float("inf"))], 0
        while heap:
            least, _, node, most = heapq.heappop(heap)
            # A window is open for this node if the annulus, cut at the k-th answer, meets the node's distances.
            open_ = [w for w in windows if least <= far(w.floor()) + rim and most >= far(w.high) - rim]
            if not open_:
                if all(least > far(w.floor()) + rim for w in windows):
                    return  # all others are farther still
                continue
            inner, outer, lo, hi, point, a0, a1, b0, b1 = self.nodes[node]
            lo, hi = int(lo), int(hi)
            if point < 0:
                scores = (self.v[lo:hi] @ q).astype(np.int64)
                fit = (self.labels[lo:hi] == label) == same
                fit &= self.ids[lo:hi] != anchor
                for w in open_:
                    w.take(scores, self.ids[lo:hi], fit)
                continue
            d = far(float(self.v[int(point)] @ q))
            for child, x0, x1 in ((inner, a0, a1), (outer, b0, b1)):
                turn += 1
                heapq.heappush(heap, (max(least, d - x1, x0 - d), turn, int(child), min(most, d + x1)))


class Wanted:
    """The first k rows with low <= score <= high: higher scores first, ties by vec_id. Bounds are whole numbers."""

    def __init__(self, k: int, low: int, high: int, kth: int | None = None):
        self.k, self.low, self.high, self.kth = k, low, high, kth
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """Rows below this score are not wanted any more."""
        least = self.low if self.kth is None else max(self.low, self.kth)
        return max(least, int(self.scores[-1])) if len(self.ids) == self.k else least

    def take(self, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        some = np.flatnonzero(fit & (scores <= self.high) & (scores >= self.floor()))
        if not len(some):
            return
        s, i = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        first = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[first], i[first]


@dataclass
class Index:
    """Rows as shards, with what queries need to know of them."""

    upper: Upper
    width: int
    salts: list[int]  # shards of each cell
    shards: DataFrame  # shard, body
    folder: str


def built(rows: DataFrame, folder: str, k: int) -> Index | None:
    """The index of rows (vec_id, label, v); None for an empty table. k: the most rows that one answer can need."""
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + CAST(x AS double) * x)"))).first()
    n, width = size[0], max(1, size[1] or 0)
    if not n:
        return None
    if size[2] >= 2**62:
        raise ValueError("scores beyond 62 bits")
    norm2 = int(size[2]) + (int(size[2]) >> 48)  # a sum of doubles may fall short by its rounding
    sample = drawn(rows, "vec_id", SAMPLE).orderBy("vec_id").collect()  # at most 2 * SAMPLE rows
    flat = np.zeros((len(sample), width), np.int64)
    for r, x in zip(flat, sample, strict=True):
        r[: len(x["v"])] = x["v"]
    cells = min(MOST_CELLS, 1 << max(0, (n // SHARD).bit_length()))
    upper = Upper.fitted(flat, cells, norm2)

    def placed(batches):
        for batch in batches:
            if len(batch):
                cell = upper.cell(matrix(batch.column(2), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "label", "v", "cell"])

    # Of equal vectors of a label, an answer (without the anchor itself) can hold the k smallest vec_ids at most.
    slim = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))).where(F.col("rn") <= k + 1).drop("rn")
    cells_of = store.written(slim.mapInArrow(placed, f"{ROWS}, cell long"), f"{folder}/cells")
    counts = {r["cell"]: r["count"] for r in cells_of.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    salts = [-(-counts.get(c, 0) // SHARD) for c in range(cells)]
    first = np.concatenate([[0], np.cumsum(salts)]).tolist()
    of = F.element_at(F.lit([*first[:-1]]), (F.col("cell") + 1).cast("int")) + F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit([max(1, s) for s in salts]), (F.col("cell") + 1).cast("int")))

    def grown(table: pa.Table) -> pa.Table:
        ids, labels = (table[c].to_numpy() for c in ("vec_id", "label"))
        at = np.argsort(ids)
        body = Shard(ids[at], labels[at], matrix(table["v"], width)[at], upper.norm2).packed()
        return pa.table({"shard": [table["shard"][0].as_py()], "body": pa.array([body], pa.binary())})

    shards = cells_of.withColumn("shard", of.cast("long")).groupBy("shard").applyInArrow(grown, "shard long, body binary")
    return Index(upper, width, salts, store.written(shards, f"{folder}/shards"), folder)


ASKED = "anchor_id long, label long, v array<long>, window long, low long, high long, kth long"


def _visits(index: Index, asked: DataFrame, home: bool) -> DataFrame:
    """asked, and the shards of the cells that its annulus meets.  home: only the cell that is nearest to the anchor,
    otherwise all but that."""
    upper, width, full = index.upper, index.width, np.array(index.salts) > 0
    first = np.concatenate([[0], np.cumsum(index.salts)])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch.column(2), width)
            reaches: dict[int, tuple] = {}
            takes, shards = [], []
            anchors, lows, highs, kths = (batch.column(c).to_pylist() for c in (0, 4, 5, 6))
            for i, a in enumerate(anchors):
                if a not in reaches:
                    reaches[a] = (*upper.reach(q[i]), float(q[i].astype(np.float64) @ q[i]) + upper.norm2)
                least, most, base = reaches[a]
                far = lambda s, b=base: max(0.0, b - 2.0 * s) ** 0.5
                rim = ROOM * base**0.5 + 1e-6
                floor = lows[i] if kths[i] is None else max(lows[i], kths[i])
                hit = (least <= far(floor) + rim) & (most >= far(highs[i]) - rim)
                # The nearest cell that has rows, by its outer distance where several may be as near.
                near = int(np.lexsort((most, np.where(full, least, np.inf)))[0])
                pick = np.array([near]) if home else np.flatnonzero(hit & full & (np.arange(len(full)) != near))
                for c in pick.tolist():
                    shards += range(int(first[c]), int(first[c + 1]))
                    takes += [i] * (int(first[c + 1]) - int(first[c]))
            rows = pa.Table.from_batches([batch]).take(pa.array(takes, pa.int64())).combine_chunks()
            yield from rows.append_column("shard", pa.array(shards, pa.int64())).to_batches(4096)

    return asked.mapInArrow(run, f"{ASKED}, shard long")


def _searched(index: Index, asked: DataFrame, blocks: int, same: bool, k: int, home: bool) -> DataFrame:
    """anchor_id, window, neighbour, score: the first k of every shard visited."""
    width, norm2 = index.width, index.upper.norm2
    # Blocks by a hash of the anchor: about QUERIES anchors each, however many there are.
    visits = _visits(index, asked, home).withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)))
    fields = F.struct("anchor_id", "label", "v", "window", "low", "high", "kth")
    grouped = visits.groupBy("shard", "block").agg(F.collect_list(fields).alias("asked"))

    def run(batches):
        for batch in batches:
            for body, asked in zip(batch.column(0), batch.column(1), strict=True):
                tree = Shard.unpacked(body.as_py(), norm2)
                by: dict[int, list] = {}
                for x in asked.as_py():
                    by.setdefault(x["anchor_id"], []).append(x)
                out: list[tuple] = []
                for anchor, xs in by.items():
                    q = np.zeros(width, np.int64)
                    q[: len(xs[0]["v"])] = xs[0]["v"]
                    windows = [Wanted(k, x["low"], x["high"], x["kth"]) for x in xs]
                    tree.search(q, anchor, xs[0]["label"], same, windows)
                    for x, w in zip(xs, windows, strict=True):
                        out += [(anchor, x["window"], i, s) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "window", "neighbour", "score"])

    met = grouped.join(index.shards, "shard").select("body", "asked")
    return met.mapInArrow(run, "anchor_id long, window long, neighbour long, score long")


def nearest(index: Index, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """anchor_id, window, rank, neighbour, score: the first k rows of the anchor's label (same) or of others whose
    score is in the window; asked has anchor_id, label, v, window, low, high."""
    asked = asked.withColumn("kth", F.lit(None).cast("long"))
    blocks = max(1, asked.select("anchor_id").distinct().count() // QUERIES)
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "neighbour")
    first = store.written(_searched(index, asked, blocks, same, k, True), f"{index.folder}/{name}-home")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("anchor_id", "window", F.col("score").alias("kth"))
    again = asked.drop("kth").join(kth, ["anchor_id", "window"], "left").select(*asked.columns)
    more = store.written(_searched(index, again, blocks, same, k, False), f"{index.folder}/{name}-more")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (whole numbers, no nulls).  anchors: a column vec_id, the rows to ask for.  Negatives satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    folder = store.scratch(spark, "negatives")
    rows = store.written(rows.select("vec_id", "label", "v"), f"{folder}/rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = built(rows, folder, max(positives, negatives))
    if index is None:
        return spark.createDataFrame([], schema)
    asked = rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "v")
    edge = index.upper.norm2 + 1
    all_scores = asked.withColumns({"window": F.lit(0).cast("long"), "low": F.lit(-edge).cast("long"), "high": F.lit(edge).cast("long")})
    near = nearest(index, all_scores, True, positives, "positives").select("anchor_id", F.col("neighbour").alias("window"), F.col("score").alias("positive_score"))
    near = store.written(near, f"{folder}/positives")
    # Whole-number bounds: the least score with 100 * score >= low * p, the largest with 100 * score <= high * p.
    p = F.col("positive_score").cast("decimal(38,0)")
    bounds = {"low": F.ceil(p * low / 100).cast("long"), "high": F.floor(p * high / 100).cast("long")}
    windows = store.written(near.join(asked, "anchor_id").withColumns(bounds).where("low <= high").select("anchor_id", "label", "v", "window", "low", "high"), f"{folder}/windows")
    found = nearest(index, windows, False, negatives, "negatives")
    out = found.join(near, ["anchor_id", "window"])
    return out.select("anchor_id", F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("neighbour").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
