"""Periodic runs against a plain search over all periods, on small and awkward tables."""

import hashlib
import random
import zlib

import pytest

from tideline.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(words, least_words=6, least_power=4):
    """All maximal stretches of smallest period q, for each q by one pass."""
    n, found = len(words), []
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least_words, least_power * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_runs_are_all_runs():
    rng = random.Random(5)
    for turn in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        while rng.random() < 0.7 and len(words) < 120:
            piece = [rng.randrange(letters) for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(words) + 1)
            words = words[:at] + piece * rng.randrange(2, 8) + piece[: rng.randrange(len(piece))] + words[at:]
        power = rng.choice([2, 3, 4])
        assert sorted(periodic.lyndon_runs(words, 6, power), key=lambda r: (r[0], r[2])) == plain_runs(words, 6, power), (turn, words)


def test_extensions_when_hashes_lie(monkeypatch):
    monkeypatch.setattr(periodic.Extensions, "_alike", lambda self, i, j, n: True)
    words = [1, 2, 3] * 9 + [4] + [1, 2] * 12 + [5] * 7
    assert sorted(periodic.lyndon_runs(words)) == sorted(plain_runs(words))


def test_long_repeats_take_no_quadratic_time():
    words = [0] * 60_000 + [1] + [0, 1, 2] * 20_000
    assert sorted(periodic.lyndon_runs(words)) == [(0, 60_000, 1), (60_001, 60_000, 3)]


TEXTS = [
    None, "", " \n\t", "a", "a a a a a", "a a a a a a", "b a a a a a a c", "x y x y x y x y", "x y x y x y x", "p q r " * 5 + "p q", "A a A a A a A a",
    "a a a a a a a a a a a a", "é ß " * 6 + "z", "to be or not " * 3, "k " * 4000 + "l m " * 900, "w" * 50_000, "n\x0bn\x0cn\rn\nn\tn n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 4), (None, TEXTS[7], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs int")


def _split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_periodic_runs_of_awkward_texts(docs):
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        words = _split(TEXTS[7 if row.doc_id is None else row.doc_id])
        runs = [(0, 4000, 1), (4000, 1800, 2)] if row.doc_id == 14 else plain_runs(words)
        assert (row.n_words, [tuple(r) for r in row.runs]) == (len(words), runs), row.doc_id
        assert row.collapsed == plain_collapsed(words, runs)


def test_other_powers_and_empty_tables(spark, docs):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for row in periodic.periodic_runs(docs.where("length(text) < 100"), 2, 2).collect():
        words = _split(TEXTS[7 if row.doc_id is None else row.doc_id])
        assert [tuple(r) for r in row.runs] == plain_runs(words, 2, 2)
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, 6, 1)


def expected(doc_id, text):
    """The contract's row in plain Python."""
    words = _split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(((s, k, q) for s, k, q in fast_runs(words)), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(plain_collapsed(words, runs)))


def fast_runs(words):
    """plain_runs with the places where words q apart agree found by array comparison."""
    import numpy as np

    number: dict = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, seen = len(x), []
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])))
        for i, j in edge.reshape(-1, 2).tolist():
            length = j - i + q
            if length >= max(6, 4 * q) and not any((x[i : i + length - p] == x[i + p : i + length]).all() for p in range(1, q) if q % p == 0):
                seen.append((i, length, q))
    return seen


def test_query_against_plain_python(spark):
    got = {r.doc_id: tuple(r) for r in periodic.op13_lyndon_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id
    assert sum(g[1] > 0 for g in got.values()) > 5
