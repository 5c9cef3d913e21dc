"""The pipeline's stages on awkward tables: nulls, repeats, empty tables, columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import neardup, store

PROSE = "the river ran low under the old bridge and nobody in the town could say when it had last been so dry in spring "
ITEM = "which of the seven lamps in the harbour was lit by the keeper on the first night of the long winter storm"
ROWS = [
    (1, None), (2, ""), (3, PROSE * 3), (4, PROSE * 3), (4, PROSE * 3), (5, PROSE + "and then " + ITEM + " as it was told to the boy at the door"), (6, "password: abcdef123456 " + PROSE[::-1] * 2), (7, "x " * 5000),
    (8, PROSE.upper() * 3), (None, "a clean text without a name of its own that nobody else has said before now"), (None, None), (9, "one"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, component_id string, rep string, label int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def made(docs=ROWS, items=((1, ITEM),), labels=()):
        d = f"file://{tmp_path_factory.mktemp('tables')}"
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", 3) for i, t in docs], DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return d

    return made


def stage(spark, name, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, d)
    return out, docs


def test_every_stage_keeps_columns_and_clean_rows(spark, tables):
    d = tables()
    gone = {"quality classifier": set(), "near duplicates": {4, 8}, "benchmark decontamination": {5}, "secret scan": set()}
    for name, ids in gone.items():
        out, docs = stage(spark, name, d)
        assert out.schema == docs.schema, name
        want = sorted((str(r.doc_id), r.score, r.kept, r.component_id, r.rep, r.label) for r in docs.collect() if r.doc_id not in ids)
        assert sorted((str(r.doc_id), r.score, r.kept, r.component_id, r.rep, r.label) for r in out.collect()) == want, name
    text = {r.doc_id: r.text for r in stage(spark, "secret scan", d)[0].where("doc_id IS NOT NULL").collect()}
    assert "abcdef123456" not in text[6] and text[7] == "x " * 5000 and text[1] is None


def test_the_run_as_a_whole(spark, tables):
    got = corpus_pipeline.run(spark, tables())
    per = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(per) == {1, 2, 3, 6, 7, 9} and per[1] == per[2] == 1 and per[7] > 4000


def test_empty_tables(spark, tables):
    none = tables(docs=[])
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, none)[0].count() == 0, name
    bare = tables(items=[], labels=[])
    for name in ("quality classifier", "benchmark decontamination"):
        assert stage(spark, name, bare)[0].count() == len(ROWS), name


def test_recall_of_copies_against_all_pairs(spark):
    """The stage finds every copy that plain sets find: on documents of sf0.01, all pairs in five words at 0.8."""
    from test_jaccard_join import plain

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {d: c for d, _, c in plain([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)}
    store.light_batches(spark)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 5, 80).collect()}
    found = sum(got[d] == c for d, c in want.items() if c != d)
    assert sum(c != d for d, c in want.items()) > 30 and found / sum(c != d for d, c in want.items()) >= 0.99
    assert all(got[d] >= want[d] for d in want)
