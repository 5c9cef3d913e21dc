"""The Jaccard join against all pairs, on small and awkward tables."""

import random

import numpy as np
import pytest

from tideline.llm import jaccard_join as jj
from tideline.llm import neardup

SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    words = lower(text).encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def plain(rows, k, percent):
    """{(doc_id, n): component_id} for each row, by all pairs of distinct sets."""
    sets = [(d, shingle_set(t, k)) for d, t in rows if d is not None]
    distinct = sorted({s for _, s in sets if s}, key=len)
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, x in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            y = distinct[j]
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(i)] = find(j)
    place, least = {s: i for i, s in enumerate(distinct)}, {}
    for d, s in sets:
        if s:
            c = find(place[s])
            least[c] = min(least.get(c, d), d)
    return sorted((d, len(s), least[find(place[s])] if s else d) for d, s in sets)


def joined(docs, **kw):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_classes(docs, **kw).collect())


def made_texts(seed, n=260):
    """Near copies, shared passages, and frequent words only."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(70)]
    base = [[word() for _ in range(rng.choice([6, 12, 30, 90, 300]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words = words + passage[: rng.choice([20, 70])]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("k", "percent", "rare", "frequent"), [(3, 90, 32, 1024), (3, 90, 2, 12), (5, 80, 1, 1), (1, 85, 3, 9)])
def test_components_of_made_texts(spark, k, percent, rare, frequent, monkeypatch):
    monkeypatch.setattr(jj, "RARE", rare)
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    rows = made_texts(k * percent + rare)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent) == plain(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_share_a_combination(percent, monkeypatch):
    """Also where nearly all tokens are frequent, and at the edge of the threshold."""
    monkeypatch.setattr(jj, "RARE", 3)
    monkeypatch.setattr(jj, "FREQUENT", 6)
    rng = np.random.default_rng(percent)
    limit = np.uint64(jj.low_limit(percent))
    linked = 0
    for _ in range(400):
        universe = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        df = dict(zip(universe.tolist(), rng.choice([1, 2, 5, 9], len(universe), p=rng.dirichlet([1, 1, 1, 1])).tolist(), strict=True))
        n = int(rng.integers(100 // (100 - percent), 500))
        x = rng.choice(universe, n, replace=False)
        lost = int(rng.integers(0, jj.spare(n, percent) + 1))
        room = 100 * (n - lost) // percent - n
        rest = np.setdiff1d(universe, x)
        y = np.concatenate([x[lost:], rng.choice(rest, int(rng.integers(0, max(0, room) + 1)), replace=False)])
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common) or len(y) * (100 - percent) < percent:
            continue
        linked += 1
        both = set(np.intersect1d(x, y).tolist())
        keys = []
        for s in (x, y):
            s = np.sort(s)
            low = s[s < limit]
            high = s[len(low) : max(len(low), min(len(s), 2 * (jj.spare(len(s), percent) + 1) + 8))]
            # Tokens in both sets are in two at least; only others are in one.
            count = {t: max(2, df[t]) if t in both else df[t] for t in low.tolist()}
            shared = [t for t in low.tolist() if count[t] > 1]
            signed = lambda a: np.array(a, np.uint64).view(np.int64).tolist()
            keys.append(set(jj.prefix_keys(len(s), len(low) - len(shared), signed(shared), [count[t] for t in shared], signed(high), percent)))
        assert keys[0] & keys[1], (len(x), len(y), common)
        assert all(len(a) <= 8 * len(s) + 40 for a, s in zip(keys, (x, y), strict=True))
    assert linked > 100


PROSE = "the river ran low under the old bridge and nobody in the town could say when it had last been so dry"
AWKWARD = [
    (0, None, 1), (1, "", 1), (2, " \n\t", 1), (3, "one", 1), (4, "ONE", 1), (5, "one two", 1), (6, PROSE, 1), (7, PROSE.upper(), 1), (7, PROSE, 2), (8, PROSE + " again", 1), (9, PROSE + " again and twice over", 1),
    (10, "a " * 30_000, 1), (11, "x" * 100_000, 1), (None, PROSE, 1), (12, PROSE[4:], 1), (12, "é ß " + PROSE, 1), (12, None, 3), (-5, "q " + PROSE, 1), (13, "a a a a", 4),
]


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, component_id int")
    for k, percent in ((3, 90), (5, 80), (3, 100)):
        assert joined(docs, k=k, percent=percent) == plain([r[:2] for r in AWKWARD], k, percent), (k, percent)
    row = next(r for r in jj.jaccard_classes(docs, k=3, percent=90).collect() if r.doc_id == 6)
    assert (row.class_id, row.n_copies) == (6, 3)
    assert jj.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        jj.jaccard_classes(docs, percent=70)


def test_near_duplicates_compare_every_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == plain([r[:2] for r in AWKWARD], 3, 85)


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.op11_token_combinations(spark, SF).collect())
    assert got == plain(rows, 3, 90)
    assert len({c for _, _, c in got}) < 0.95 * len(got)


def test_second_round_has_no_buckets_of_two(spark, monkeypatch):
    """Texts that share one sentence with one other each: the first round has compared all there is to compare."""
    rows = []
    for i in range(0, 60, 2):
        shared = " ".join(f"s{i}x{j}" for j in range(30))
        rows += [(i + e, f"{shared} " + " ".join(f"o{i + e}x{j}" for j in range(6))) for e in (0, 1)]
    seen, written = {}, jj.store.written
    monkeypatch.setattr(jj.store, "written", lambda df, path: seen.setdefault(path.rsplit("/", 1)[-1], written(df, path)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90) == plain(rows, 3, 90)
    assert seen["star"].count() > 0 and seen["open"].count() == 0


def test_a_group_that_no_set_holds_together_takes_few_pairs(spark, monkeypatch):
    """Copies with three of sixty changes each: two are linked if they share one, so no set is linked with all."""
    rng = random.Random(5)
    base, n = [f"w{i}" for i in range(200)], 400
    own = [set(rng.sample(range(60), 3)) for _ in range(n)]
    texts = [" ".join(f"{w}x" if i % 3 == 1 and i // 3 in c else w for i, w in enumerate(base)) for c in own]
    pairs, real = [], jj.store.written

    def written(df, path, *a, **k):
        out = real(df, path, *a, **k)
        if path.endswith("-pairs"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jj.store, "written", written)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_classes(docs, 3, 90).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(198)} for t in texts]
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (396 - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert got == {i: top(i) for i in range(n)}
    assert sum(pairs) < 8 * n


def test_sets_of_a_group_meet_few_central_sets(spark, monkeypatch):
    """Copies with two of sixty changes each share many buckets, whose most central sets differ; a set is compared with a
    few of them, however many buckets it is in."""
    rng = random.Random(3)
    base, n = [f"w{i}" for i in range(180)], 60
    own = [set(rng.sample(range(60), 2)) for _ in range(n)]
    texts = [" ".join(f"{w}x" if i % 3 == 1 and i // 3 in c else w for i, w in enumerate(base)) for c in own]
    first, real = [], jj.store.written

    def written(df, path, *a, **k):
        out = real(df, path, *a, **k)
        if path.endswith("/first-pairs") or path.endswith("/star-pairs"):
            first.append(out.count())
        return out

    monkeypatch.setattr(jj.store, "written", written)
    rows = list(enumerate(texts))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90) == plain(rows, 3, 90)
    assert first and first[0] <= 2 * n
