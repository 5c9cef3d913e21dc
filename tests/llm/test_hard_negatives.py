"""Hard negatives against brute force, on small and awkward tables."""

import math

import duckdb
import numpy as np
import pytest

from tideline.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"


def brute(rows, anchors, positives=5, negatives=10):
    """rows: {vec_id: (label, vector of Python numbers)}."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a in sorted(anchors):
        if a not in rows:
            continue
        label, v = rows[a]
        ranked = sorted((-dot(v, w), i, k) for i, (k, w) in rows.items() if i != a)
        for p, i in [(-s, i) for s, i, k in ranked if k == label][:positives]:
            hard = [(i2, -s) for s, i2, k in ranked if k != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(a, i, r, n, p, s) for r, (n, s) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, table, anchors, **kw):
    df = hn.whole_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, score string"), scale=1)
    return sorted(tuple(r) for r in hn.hard_negatives(df, spark.createDataFrame([(a,) for a in anchors], "vec_id long"), **kw).collect())


@pytest.fixture
def small_parts(monkeypatch):
    """Many cells, shards and leaves on few rows."""
    for name, value in {"SAMPLE": 60, "SHARD": 24, "LEAF": 4, "QUERIES": 3}.items():
        monkeypatch.setattr(hn, name, value)


def test_many_shards_with_ties_copies_and_repeats(spark, small_parts):
    rng = np.random.default_rng(3)
    v = rng.integers(-6, 7, (400, 5))
    v[100:160] = v[7]  # a hot vector, in many labels
    v[160:190] = 0
    label = rng.integers(0, 4, 400)
    label[:150] = 1  # a hot label
    table = [(i, v[i].astype(float).tolist(), int(label[i]), "x") for i in range(400)]
    rows = {i: (int(label[i]), v[i].tolist()) for i in range(400)}
    table += table[50:70] + [(None, [1.0] * 5, 1, "x"), (900, None, 1, "x"), (901, [1.0, None, 2.0, 1.0, 1.0], 1, "x"), (902, [1.0, math.nan, 0.0, 0.0, 0.0], 1, "x"), (903, [math.inf] * 5, 1, "x"), (904, [5.0] * 5, None, "x"), (905, [], 2, "x"), (906, [6.0, 6.0], 3, "x"), (3, [99.0] * 5, 5, "x")]
    rows |= {905: (2, []), 906: (3, [6, 6])}
    anchors = [*range(0, 400, 9), 120, 170, 905, 906, 12345]
    assert mined(spark, table, anchors) == brute(rows, anchors)
    assert len(brute(rows, anchors)) > 500


def test_clusters_let_cells_be_left_out(spark, small_parts):
    rng = np.random.default_rng(4)
    centre = rng.integers(-400, 400, (8, 6))
    v = centre[np.arange(320) % 8] + rng.integers(-9, 10, (320, 6))
    table = [(i, v[i].astype(float).tolist(), int(i // 8 % 3), "x") for i in range(320)]
    rows = {i: (int(i // 8 % 3), v[i].tolist()) for i in range(320)}
    assert mined(spark, table, range(0, 320, 7)) == brute(rows, range(0, 320, 7))
    upper = hn.Upper.fitted(v, 8, int((v * v).sum(axis=1).max()))
    least, most = upper.reach(v[0])
    cell, d = upper.cell(v), hn.distances(hn.augmented(v, upper.norm2), np.append(v[0].astype(float), 0.0))
    assert all(least[c] - 1e-6 <= x <= most[c] + 1e-6 for c, x in zip(cell, d, strict=True))
    assert (least > 0).any()


def test_a_tree_visits_few_leaves_and_finds_all(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 4)
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (16, 3))[np.arange(600) % 16] + rng.integers(-4, 5, (600, 3))
    label, norm2 = rng.integers(0, 3, 600), int((v * v).sum(axis=1).max())
    tree = hn.Shard.unpacked(hn.Shard(np.arange(600), label, v, norm2).packed(), norm2)
    assert len(tree.nodes) > 200
    taken = []
    monkeypatch.setattr(hn.Wanted, "take", lambda self, s, i, f, real=hn.Wanted.take: (taken.append(len(s)), real(self, s, i, f))[1])
    for a in range(0, 600, 13):
        scores = v @ v[a]
        for low, high in ((-norm2, norm2), (norm2 // 9, norm2 // 2), (0, norm2 // 20)):
            w = hn.Wanted(7, low, high)
            tree.search(v[a], a, int(label[a]), False, [w])
            fit = [i for i in range(600) if i != a and label[i] != label[a] and low <= scores[i] <= high]
            assert w.ids.tolist() == sorted(fit, key=lambda i: (-scores[i], i))[:7]
    assert sum(taken) < 0.25 * 600 * 3 * 47


def test_large_numbers_stay_exact(spark):
    big = 1 << 28
    table = [(i, [float(big + 32 * i), float(-big + 64 * (i % 3))], i % 2, "x") for i in range(30)]
    rows = {i: (i % 2, [int(np.float32(a)) for a in v]) for i, v, _, _ in table}
    got = mined(spark, table, [0, 5, 10])
    assert got == brute(rows, [0, 5, 10])
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1, "x")], [0])


def test_nothing_to_find(spark):
    assert mined(spark, [], [0]) == []
    assert mined(spark, [(0, [1.0], 1, "x")], [0]) == []
    assert mined(spark, [(0, [1.0], 1, "x"), (1, [2.0], 1, "x"), (2, [-2.0], 2, "x")], [0, 7]) == []


def test_query_against_sql(spark):
    got = sorted(tuple(r) for r in hn.op12_vantage_points(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(hn.OP12_SQL).fetchall()) and len(got) > 100
