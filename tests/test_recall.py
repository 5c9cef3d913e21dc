"""Engine queries against DuckDB on the smallest tables, and hand-computed values."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.engine import Engine
from tideline.functions import judge, model, text
from tideline.operators import identity, index, ledger, metrics, pack, rank, replay, stats, strength
from tideline.plans.catalogue import ORACLES, QUERIES
from tideline.sources import scratch, synthetic, tables
from tideline.streaming.strength import step

SF = "/root/testdata/sf0.001"
QUICK = ["keyword_fallback", "summary_160", "content_id", "downgrade_100", "strength_after_access", "identity_collapse", "prune_weakest", "cosine_top10", "bm25_top10", "dense_top10", "pack_tiered", "recall_flagship", "pack_truncate", "truncated_text", "record_metrics", "cliffs_delta", "holm", "near_duplicates_090", "restatements", "sketch_bottom8", "sketch_candidates", "stream_strength", "merge_duplicates", "refresh_full", "strength_as_of", "pool_600", "cosine_tf_top10", "recall_text", "ledger_state", "supersession", "restate_after_retire", "judge_expressions", "refresh_delta", "nth_by_kind", "wilcoxon_p", "bootstrap_ci", "paired_summary", "replay_feedback"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "events", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


def test_goldens(spark):
    one = spark.range(1)
    row = one.select(
        F.round(0.6 * F.exp(-model.rate(F.lit("general")) * 7), 6).alias("week"),
        text.content_id(F.lit("User prefers concise replies.")).alias("id"),
        metrics.ndcg(F.array(*map(F.lit, ["x", "e1", "y", "e2"])), F.array(F.lit("e1"), F.lit("e2"))).alias("ndcg"),
        metrics.reciprocal_rank(F.array(*map(F.lit, ["x", "e1", "y", "e2"])), F.array(F.lit("e1"), F.lit("e2"))).alias("rr"),
        metrics.stale_leak(F.array(F.lit("s2"), F.lit("x")), F.array(F.lit("s1"), F.lit("s2"))).alias("leak"),
        *[model.tier(F.lit(s), F.lit(False)).alias(f"t{i}") for i, s in enumerate((0.9, 0.5, 0.3, 0.11, 0.1, 0.0))],
        model.tier(F.lit(0.0), F.lit(True)).alias("pinned"),
    ).first()
    assert row["week"] == pytest.approx(0.486351, abs=1e-6)
    assert row["id"] == "m-00c6dc2859"
    assert row["ndcg"] == pytest.approx(0.6509217, abs=1e-6)
    assert (row["rr"], row["leak"], row["pinned"]) == (0.5, 0.5, "active")
    assert [row[f"t{i}"] for i in range(6)] == ["active", "latent", "latent", "latent", "archived", "archived"]
    assert stats.wilcoxon_p([0, 0]) == 1.0
    assert stats.wilcoxon_p([1, 2, 3]) == 0.25


def test_closed_form_is_the_stepwise_fold(spark):
    times = [0.0, 3.5, 3.5, 10.0, 41.25]
    m = spark.createDataFrame([("m", "a text", "task", 0.0)], "id string, content string, category string, created double")
    e = spark.createDataFrame([(i, "m", "access", t * model.DAY) for i, t in enumerate(times)], "seq long, id string, op string, ts double")
    now = 50 * model.DAY
    s, at = model.INITIAL, 0.0
    for t in times:
        s, at = step(s, at, model.RATES["task"], t * model.DAY, "access")
    want = s * math.exp(-model.RATES["task"] * (now - at) / model.DAY)
    assert strength.fold(m, e, now).first()["strength"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("budget", [0, 1, 37, 128, 500])
def test_budget_is_a_ceiling(spark, budget):
    rows = [("q", f"m{i}", i, 1.0 / (i + 1), "active", "x" * (7 * i + 1), 7 * i + 1, 3, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "qid string, id string, rank int, utility double, tier string, content string, full int, summary int, gist int")
    state = pack.with_bodies(df.select("id", "content", "tier"))
    bodies = df.drop("full", "summary", "gist").join(state.drop("content", "tier"), "id")
    asked = spark.createDataFrame([("q",), ("none",)], "qid string")
    for packed in (pack.in_order(bodies, F.lit("full"), budget), pack.tiered(bodies, budget), pack.by_worth(bodies, budget), pack.truncated(bodies, budget)):
        rows = pack.rendered(pack.for_all(packed, asked), state).collect()
        assert len(rows) == 2 and all(r["chars"] <= budget and r["chars"] == len(r["text"]) for r in rows)
        assert all(sum(r["tiers"].values()) == len(r["used"]) for r in rows)


EVENTS = "seq long, op string, ts double, id string, content string, category string, protected boolean, supersedes string"


def _log(spark, *rows):
    """Rows of (op, day, id, content, supersedes, protected), in order."""
    full = [(i, r[0], r[1] * model.DAY, r[2], *(r[3:4] or (None,)), "general", bool(r[5:6] and r[5]), *(r[4:5] or (None,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def test_a_pin_counts_from_its_day(spark):
    m = spark.createDataFrame([("m", "a text", "general", 0.0)], "id string, content string, category string, created double")
    e = spark.createDataFrame([(1, "m", "pin", 20 * model.DAY), (2, "m", "retire", 30 * model.DAY)], "seq long, id string, op string, ts double")
    at = lambda d: strength.fold(m, e, d * model.DAY).first()
    assert at(10)["strength"] == pytest.approx(0.6 * math.exp(-0.3), abs=1e-9) and not at(10)["pinned"] and not at(10)["retired"]
    assert at(25)["strength"] == 1.0 and at(25)["tier"] == "active" and at(35)["retired"]


def test_the_write_path(spark):
    """Collapse, restatement after a retire, replacement, retires of rows that never were, numbers behind equal ids."""
    log = _log(
        spark, ("add", 0, "a", "The lamp is lit."), ("add", 1, "b", "  The lamp is lit. "), ("retire", 2, "b"), ("add", 3, "c", "The lamp is lit."), ("retire", 4, "a"), ("add", 5, "d", "The lamp is lit."),
        ("add", 6, "e", "The lamp is out.", "d"), ("add", 7, None, "One, two!"), ("add", 7, None, "one two"), ("add", 8, "f", "one two", None, True), ("add", 9, "a", "another"), ("add", 9, "g", "   "), ("access", 9, "c"), ("pin", 9, "zzz"),
    )
    rows, events = ledger.resolve(log)
    got = {r["id"]: r for r in strength.fold(rows, events, 10 * model.DAY).collect()}
    name = text.content_id(F.lit("one two"))
    twin = spark.range(1).select(name.alias("n")).first()["n"]
    assert set(got) == {"a", "d", "e", twin, f"{twin}-2"}
    assert [got[k]["retired"] for k in ("a", "d", "e")] == [True, True, False]
    assert got["a"]["n_access"] == 2 and got["d"]["superseded_by"] == "e"
    assert got[f"{twin}-2"]["pinned"] and got[f"{twin}-2"]["n_access"] == 1 and not got[twin]["pinned"]
    rows, events = ledger.resolve(log, stale_retirement=False)
    assert not {r["id"]: r["retired"] for r in strength.fold(rows, events, 10 * model.DAY).collect()}["d"]
    assert ledger.resolve(log.limit(0))[0].count() == 0


def test_merges_leave_retired_rows_alone(spark):
    cols = "id string, content string, category string, created double, n_access long, last_access double, strength double, pinned boolean, retired boolean, tier string"
    rows = [("a", "x", "general", 0.0, 1, 5.0, 0.3, False, False, "latent"), ("b", "x ", "general", 1.0, 2, 3.0, 0.2, False, False, "latent"), ("c", "x", "general", 2.0, 4, 9.0, 0.9, False, True, "active"), ("d", "y", "general", 0.0, 0, 0.0, 0.05, False, False, "archived")]
    s = spark.createDataFrame(rows, cols)
    got = {r["id"]: (r["n_access"], r["strength"], r["created"], r["last_access"], r["retired"]) for r in strength.merged(s).collect()}
    assert got == {"b": (3, 0.3, 0.0, 5.0, False), "c": (4, 0.9, 2.0, 9.0, True), "d": (0, 0.05, 0.0, 0.0, False)}
    report = strength.refresh_report(s, 0.0, 10 * model.DAY, 2).first().asDict()
    assert report == {"decayed": 4, "merged": 1, "pruned": 1, "prune_deficit": 0, "total": 2}
    one = spark.createDataFrame([(2,)], "most long")
    assert [r["id"] for r in strength.pruned(s, one).collect()] == ["d"]
    assert strength.pruned(s, one.select(F.lit(0))).count() == 0 and strength.refresh_report(s.limit(0), 0.0, 1.0).first()["total"] == 0


def test_pools_hold_rows_that_match_nothing(spark):
    cols = "id string, content string, strength double, last_access double, created double, pinned boolean, retired boolean, tier string"
    rows = [("a", "red fox", 0.2, 1.0, 0.0, False, False, "latent"), ("b", "blue jay", 0.9, 2.0, 0.0, False, False, "active"), ("c", "", 0.5, 3.0, 0.0, True, False, "active"), ("d", "red", 0.9, 9.0, 0.0, False, True, "active")]
    s = spark.createDataFrame(rows, cols)
    live = s.where("NOT retired")
    terms = index.idf_terms(index.document_frequency(live), live)
    q = spark.createDataFrame([("q1", "a red fox"), ("q2", "nothing known"), ("q3", None)], "qid string, query string")
    sims = index.cosine((terms, index.impacts(live, terms)), q)
    assert [(r["qid"], r["id"]) for r in sims.collect()] == [("q1", "a")]
    got = {k: [r["id"] for r in rank.candidates(sims, s, q).where(f"qid = '{k}'").orderBy("rank").collect()] for k in ("q1", "q2", "q3")}
    assert got == {"q1": ["c", "a", "b"], "q2": ["c", "b", "a"], "q3": ["c", "b", "a"]}
    assert index.idf_terms(index.document_frequency(live.limit(0)), live.limit(0)).count() == 0


def test_judge_expressions(spark):
    raw = ['{"score": 1, "reason": "x"}', '```json\n{"score": 0}\n```', "1", 'so "score": 1 then', "I say 0 here", "none", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(judge.parse_score(F.col("x"))).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0, 0.0, None, None]
    one = spark.range(1).select(
        judge.gold_in(F.lit("May 7"), F.lit("on 7 june")).alias("n"), judge.gold_in(F.lit("in May"), F.lit("last may it was")).alias("m"), judge.gold_in(F.lit("!!"), F.lit("x")).alias("none"),
        judge.day_of(F.lit("D12:3")).alias("day"), judge.kind(F.lit(5)).alias("k"), judge.format_p(F.lit(0.0004)).alias("p"), judge.cell(F.lit(1234.5)).alias("c"),
        judge.nth_of(F.array(*map(F.lit, [4, 1, 3, 2])), 0.5).alias("nth"), judge.oracle_grade(F.lit("Ada"), F.lit("ada!"), F.lit(""), F.lit("exact")).alias("g"),
    ).first()
    assert tuple(one) == (True, True, False, 12, "adversarial", "p<0.001", "1234", 3, 1.0)


def test_summaries(spark):
    cols = "arm string, qid string, used array<string>, ranked array<string>, evidence array<string>, stale array<string>, chars long, budget long, kind string, cold boolean, latency_ms double, judge_state string, judge_score double"
    rows = [("x", "1", ["e"], ["o", "e"], ["e"], ["s"], 200, 200, "k", True, 9.0, "judged", 1.0), ("x", "2", ["s"], ["o"], ["e"], ["s", "t"], 200, 200, "l", False, 1.0, "skipped", 0.0), ("x", "3", [], [], [], None, 200, 200, "l", False, 3.0, "errored", 0.0)]
    [r] = metrics.summary(metrics.per_record(spark.createDataFrame(rows, cols)), "arm").collect()
    want = {"queries": 3, "scored_queries": 2, "judged_queries": 1, "judge_skipped": 1, "judge_errors": 1, "task_success": 1, "hit_rate": 0.5, "mrr": 0.25, "mrr_packed": 0.5, "evidence_precision": 0.5, "stale_leak_rate": 0.25, "mean_chars": 200, "budget_utilisation": 1, "mean_latency_ms": 2, "p50_latency_ms": 2, "cold_ms": 9, "warm_samples": 2, "chars_per_hit": 400}
    assert {k: r[k] for k in want} == want and len(r) == 23
    out = {(x["field"], x["value"]): x["queries"] for x in metrics.summary_by(metrics.per_record(spark.createDataFrame(rows, cols)), "kind").collect()}
    assert out == {("all", "all"): 3, ("kind", "k"): 1, ("kind", "l"): 2}
    none = metrics.summary(metrics.per_record(spark.createDataFrame([rows[1]], cols)), "arm").first()
    assert none["chars_per_hit"] == float("inf") and "| inf |" in metrics.table([none.asDict()], ["arm", "chars_per_hit"])


def test_normal_branch_of_the_signed_rank_test():
    """21 differences 1 to 21, three of them negative: w+ = 225, mean 115.5, variance 827.75."""
    d = [-x if x in (1, 2, 3) else x for x in range(1, 22)]
    z = (225 - 115.5 - 0.5) / math.sqrt(827.75)
    assert stats.wilcoxon_p(d) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_sketches_are_the_smallest_checksums(spark):
    import zlib

    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha the of"
    words = {w for w in t.split() if w not in ("the", "of")}
    got = spark.range(1).select(text.sketch(F.lit(t)).alias("s")).first()["s"]
    assert got == sorted(zlib.crc32(w.encode()) for w in words)[:8]
    m = spark.createDataFrame([("a", t), ("b", t + " more"), ("c", "other words")], "id string, content string")
    assert {(r["a"], r["b"]) for r in index.sketch_candidates(m).collect()} == {("a", "b"), ("b", "a")}


def test_restatements_and_updates(spark):
    """Equal sets: the stronger wins, then the older. Others at 0.9: the newer wins, though it is weaker."""
    words = " ".join(f"w{i}" for i in range(19))
    rows = [("a", f"{words} old", 0.9, 0.0), ("b", f"old {words}", 0.5, 1.0), ("c", f"{words} old new", 0.4, 2.0), ("d", "something else", 0.9, 0.0), ("e", "", 0.9, 0.0), ("f", None, 0.9, 0.0)]
    m = spark.createDataFrame(rows, "id string, content string, strength double, created double")
    pairs = identity.verified(m.alias("x").join(m.alias("y"), F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).where("a <> 'e'"), m)
    got = {tuple(r) for r in identity.matched(pairs, m).collect()}
    assert got == {("a", "b", "restatement", "a"), ("b", "a", "restatement", "a"), ("c", "a", "update", "c")}
    assert identity.matched(pairs.limit(0), m).count() == 0


def test_long_runs_of_blanks_are_read_once(spark):
    import time

    began = time.time()
    [r] = spark.createDataFrame([("x" + " " * 200_000 + "y",)], "t string").select(F.length(text.trimmed(F.col("t"))), text.collapsed(F.col("t"))).collect()
    assert tuple(r) == (200_002, "x y") and time.time() - began < 20


def test_replay_is_as_of_each_query(spark):
    """Two queries of a scenario: the later sees the replacement, the retire and what the earlier one used."""
    cols = "scenario string, seq long, day double, op string, id string, content string, category string, protected boolean, supersedes string"
    e = spark.createDataFrame([("s", 0, 0.0, "add", "old", "the key is under the stone", "general", False, None), ("s", 1, 1.0, "add", "x", "a red fox ran", "general", False, None), ("s", 2, 5.0, "add", "new", "the key is in the shed", "general", False, "old")], cols)
    q = spark.createDataFrame([("q1", "s", 2.0, "where is the key", "stone", ["old"], [], "k", "t"), ("q2", "s", 6.0, "where is the key", "shed", ["new"], ["old"], "k", "t")], "qid string, scenario string, session double, query string, answer string, evidence array<string>, stale array<string>, kind string, source string")
    arms = [a for a in replay.ARMS if a.name in ("M0", "M1", "M2", "M3", "M8", "M9", "M10")]
    got = {(r["arm"], r["qid"]): (r["used"], r["judge_score"]) for r in replay.replay(arms, e, q).collect()}
    assert got["M0", "q1"] == ([], 0.0) and got["M1", "q1"][0] == ["old", "x"] and got["M2", "q2"][0] == ["new", "x", "old"]
    assert got["M3", "q1"][0] == ["old"] and set(got["M8", "q2"][0]) == {"old", "new", "x"}
    assert got["M9", "q2"][0][0] == "new" and "old" not in got["M9", "q2"][0] and got["M9", "q2"][1] == 1.0
    assert set(got["M10", "q2"][0]) == {"new", "x"}


def test_made_corpus_and_sweep(spark):
    e, q = synthetic.corpus(spark, 40, tail=10), synthetic.corpus_queries(spark, 40)
    assert e.where("op = 'add'").count() == 40 and e.where("op = 'access'").count() == 110 and q.count() == 5
    assert synthetic.corpus(spark, 0, tail=0, hot=0).count() == 0 and synthetic.corpus_queries(spark, 40, most=0).count() == 0
    arms = replay.swept(replay.ARMS[9], "prior", (0.0, 0.5))
    assert [(a.name, a.prior, a.order) for a in arms] == [("prior=0", 0.0, "blend"), ("prior=0.5", 0.5, "blend")]
    with pytest.raises(ValueError):
        replay.swept(replay.ARMS[9], "order", ("bm25",))
    r = replay.replay(arms, e, q).collect()
    assert len(r) == 10 and all(x["evidence"][0] in x["used"] and x["judge_score"] == 1.0 for x in r)


def test_engine(spark, tmp_path):
    now = [0.0]
    with Engine(spark, str(tmp_path / "store"), clock=lambda: now[0]) as e:
        a = e.add("The lamp is lit.", memory_id="a")
        assert a == "a" and e.add(" The lamp is lit. ") == "a" and e.size() == 1
        for bad in (dict(content="  "), dict(content="x", memory_id="a"), dict(content="x", supersedes="zz"), dict(content="The lamp is lit.", supersedes="a")):
            with pytest.raises(ValueError):
                e.add(**bad)
        now[0] = 1.0
        b = e.add("The lamp is out.", category="TASK", supersedes="a")
        assert e.get("a")["retired"] and e.get("a")["superseded_by"] == b and not e.access("a") and not e.pin("a") and e.retire("a")
        r = e.recall(query="is the lamp lit", budget=100)
        assert (r.text, r.used_ids, r.ranked_ids, r.retired_excluded, r.tiers) == ("The lamp is out.", [b], [b], 1, {"active": 1})
        assert e.recall(budget=100).used_ids == [] and e.recall(query="lamp", force_similarity=False).similarity_used is False
        assert e.reinforce([b, "zz"]) == 1 and e.similarity_scores("lamp")[b] > 0 and e.candidate_pool("lamp") == [b]
        assert e.refresh() == {"decayed": 1, "merged": 0, "pruned": 0, "prune_deficit": 0, "total": 2} and e.stats()["retired"] == 1
        e.save()
        with pytest.raises(ValueError):
            e.save(str(tmp_path / "elsewhere"))
        with pytest.raises(RuntimeError):
            Engine(spark, str(tmp_path / "store"))
    with Engine(spark, str(tmp_path / "store"), clock=lambda: now[0]) as e:
        assert e.size() == 2 and [m["id"] for m in e.snapshot()["memories"]] == sorted(["a", b])


def test_rpc_and_command_line(spark, tmp_path):
    import io
    import json

    from tideline import cli, rpc

    s = rpc.Server(Engine(spark, in_memory=True, clock=lambda: 0.0))
    call = lambda name, **args: json.loads(s.line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})))
    code = lambda raw: json.loads(s.line(raw))["error"]["code"]
    assert code("{") == -32700 and code("[1]") == -32600 and code('{"jsonrpc":"2.0","id":1,"method":"x"}') == -32601
    assert call("memory_add")["error"]["code"] == -32602 and call("memory_recall", budget=-1)["error"]["code"] == -32602 and call("memory_pin", id=" ")["error"]["code"] == -32602
    assert s.line('{"jsonrpc":"2.0","method":"tools/call","params":{"name":"memory_add","arguments":{"content":"x"}}}') is None and s.engine.size() == 0
    made = json.loads(call("memory_add", content="The lamp is lit.")["result"]["content"][0]["text"])["id"]
    assert json.loads(call("memory_access", id=made)["result"]["content"][0]["text"]) == {"ok": True, "id": made}
    assert call("memory_add", content="x", supersedes="zz")["result"]["isError"]
    out = io.StringIO()
    with Engine(spark, str(tmp_path / "c"), clock=lambda: 0.0) as e:
        run = lambda *a: cli.run(e, cli.parser().parse_args(a), out)
        assert run("add", "--content", "A fox.", "--id", "f") == 0 and run("pin", "f") == 0 and run("pin", "g") == 1 and run("recall", "--query", "fox") == 0 and run("list") == 0 and run("stats") == 0
    assert "A fox." in out.getvalue() and "1.0000" in out.getvalue()
    assert cli.main(["recall", "--budget", "-1"], spark) == 2


def test_a_batch_reads_the_postings_of_its_terms_only(spark):
    rows = [(f"m{i}", f"word{i % 97} other{i % 31} tail{i}") for i in range(400)]
    m = spark.createDataFrame(rows, "id string, content string")
    terms = index.idf_terms(index.document_frequency(m), m)
    from tideline.sources import scratch

    postings = scratch.written(index.bucketed(index.impacts(m, terms)), scratch.folder(spark, "postings"), ("bucket",))

    def read(*queries):
        sims = index.cosine((terms, postings), spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "qid string, query string"))
        plan = sims._jdf.queryExecution().executedPlan().toString()
        return sims.count(), [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:] if "bucket" in x.split("]")[0]]

    one, many = read("word3"), read(*[f"word{i} other{i % 31}" for i in range(60)])
    assert one[0] == 5 and many[0] > 400 and one[1] and many[1]  # the folders are a filter of the scan
    folders = lambda q: len({r[0] for r in spark.createDataFrame([(x,) for x in q], "t string").select(index.bucket("t")).collect()})
    assert folders(["word3"]) == 1 < 30 < folders([w for i in range(60) for w in (f"word{i}", f"other{i % 31}")])
    assert postings.where("bucket = -1").count() == 0 and {r["id"] for r in postings.where("term = 'word3'").collect()} == {f"m{i}" for i in range(3, 400, 97)}


def test_large_batches_are_summed_where_rows_are(spark):
    m = spark.range(300).selectExpr("concat('m', id) AS id", "concat('common word', id % 7, ' word', id, ' word', id, if(id % 2 = 0, ' even', '')) AS content")
    q = spark.createDataFrame([("q1", "common word3 word17"), ("q2", "even word250 word250"), ("q3", "unknown"), ("q4", None)], "qid string, query string")
    bags = scratch.keyed(index.bags(m, 8), scratch.folder(spark, "bags"), "id", 8)
    terms = scratch.written(index.terms_of(bags, m), scratch.folder(spark, "terms"))
    norms = scratch.keyed(index.norms(bags, terms), scratch.folder(spark, "norms"), "id", 8)
    got, plain = (terms, bags, norms), (terms, index.impacts(m, terms))
    rows = lambda df: sorted((r["qid"], r["id"], r["sim"]) for r in df.collect())
    for f in (index.cosine, index.bm25, lambda i, x: index.cosine(i, x, repeats=True, limit=None)):
        assert rows(f(got, q)) == rows(f(plain, q))
        assert not re.search(r"Exchange hashpartitioning\(qid#\d+, id#", f(got, q)._jdf.queryExecution().executedPlan().toString())
    old = index.MOST_FREQUENT
    try:
        index.MOST_FREQUENT = 5
        few = {r["id"]: (round(r["n1"], 9), round(r["n2"], 9)) for r in index.norms(bags, terms).collect()}
    finally:
        index.MOST_FREQUENT = old
    assert few == {r["id"]: (round(r["n1"], 9), round(r["n2"], 9)) for r in norms.collect()}


def test_dense_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (9000, 3)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9100, None), (9101, []), (9102, [1.0]), (9103, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.where("id IN (0, 7, 9100, 9102)")
    got = {}
    for r in rank.top(index.dense(df, q, 12), 12).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["sim"]))
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1.0, n)
    for i in (0, 7):
        s = np.round(unit @ unit[i], 6)
        assert [g[0] for g in got[i]] == sorted(range(9000), key=lambda j: (-s[j], j))[:12]
    assert set(got) == {0, 7} and index.dense(df, df.limit(0), 3).count() == 0
    import pytest as _pytest

    with _pytest.raises(ValueError):
        index.dense(df, spark.range(3_000_000).selectExpr("id", "array(1D, 2D, 3D) AS embedding"), 1)


def test_scale_rows_and_the_criterion_of_time(spark):
    from tideline.operators import scale

    e, q = synthetic.corpus(spark, 60, tail=10), synthetic.corpus_queries(spark, 60, most=2)
    rows = scale.rows(spark, [a for a in replay.ARMS if a.name in ("M3", "M14")], e, q, passes=2)
    got = {r["arm"]: r for r in rows.collect()}
    assert set(got) == {"M3", "M14"} and all(r["memories"] == 60 and 0 < r["p50_ms"] <= r["p95_ms"] <= r["total_ms"] and r["cold_ms"] > 0 for r in got.values())
    assert scale.at([3.0, 1.0, 2.0, 4.0], 0.5) == 3.0 and scale.at([], 0.5) == 0.0
    one = spark.createDataFrame([("M14", 0.8, 100.0), ("M1", 0.5, 400.0), ("M3", 0.84, 90.0)], "arm string, hit_rate double, chars_per_hit double")
    leaks = spark.createDataFrame([("staleness", 0.1)], "source string, stale_leak_rate double")
    pairs = spark.createDataFrame([("M1", True, 0.2), ("M2", False, 0.1)], "name string, significant boolean, mean_diff double")
    said = [r["status"] for r in stats.verdict(one, leaks, pairs, "M14", ["M1", "M2"], ["M3", "M4"], ["M14"], rows).orderBy("n").collect()]
    assert said == ["PASS", "PASS", "PASS", "PASS", "NOT MEASURED", "INFORMATIONAL", "FAIL"]
    none = [r["status"] for r in stats.verdict(one.limit(0), leaks.limit(0), pairs.limit(0), "M14", ["M1", "M2"], ["M3"], ["M14"]).orderBy("n").collect()]
    assert none == ["PASS", "PASS", "FAIL", "NOT MEASURED", "NOT MEASURED", "NOT MEASURED", "NOT MEASURED"]


def _most_rows(df):
    """The most rows that a step of the plan gave when df was collected."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        for inner in ("executedPlan", "plan"):
            if (inner == "executedPlan") == (node.getClass().getSimpleName() == "AdaptiveSparkPlanExec") and hasattr(node, inner) and (inner == "executedPlan" or "QueryStage" in node.getClass().getSimpleName()):
                todo.append(getattr(node, inner)())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        m = node.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
    return most


@pytest.mark.parametrize("scan,most", [(96, 64), (7, 3), (1, 2), (30, 1)])
def test_sketch_candidates_do_not_meet_all_rows_of_a_value(spark, scan, most, monkeypatch):
    """Against plain Python, where all rows share one value and many share others; frequent values and others."""
    import random
    import zlib

    monkeypatch.setattr(index, "FREQUENT", 50)
    monkeypatch.setattr(index, "MOST_VALUES", 1 << 20)
    rng = random.Random(scan)
    words = sorted((f"w{i}x" for i in range(400)), key=lambda w: zlib.crc32(w.encode()))
    texts = {f"m{i:04d}": [words[0], *(rng.choice(words[1:9]) for _ in range(3)), *(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(9)))] for i in range(400)}
    sketch = {i: sorted({zlib.crc32(w.encode()) for w in t})[:8] for i, t in texts.items()}
    posts = {}
    for i, s in sketch.items():
        for k in s:
            posts.setdefault(k, []).append(i)
    want = set()
    for a, s in sketch.items():
        seen, shared = 0, {}
        for k in sorted(s, key=lambda k: (len(posts[k]), k)):
            if seen >= scan:
                break
            seen += len(posts[k])
            for b in posts[k]:
                if b != a:
                    shared[b] = shared.get(b, 0) + 1
        want |= {(a, b, n) for b, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:most]}
    m = spark.createDataFrame([*((i, " ".join(t)) for i, t in texts.items()), (None, words[0]), ("z", None), ("zz", "")], "id string, content string")
    got = index.sketch_candidates(m.where("id IS NOT NULL"), scan, most)
    assert {(r["a"], r["b"], r["shared"]) for r in got.collect()} == want
    assert _most_rows(got) <= len(texts) * max(scan, most, 8)  # all rows of values: 400 * 400 pairs and more
    assert index.sketch_candidates(m, scan, most).where("a IS NULL OR b IS NULL").count() == 0
    assert index.sketch_candidates(m.limit(0), scan, most).count() == 0


def test_the_ledger_deals_out_no_texts(spark, monkeypatch):
    """A log with names of texts instead of texts gives the same rows and events; the ledger's queries take that."""
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    full, named = (ledger.resolve(tables.mem_log(spark, SF, named)) for named in (False, True))
    assert "content" not in named[0].columns
    for x, y in zip(full, named, strict=True):
        columns = [c for c in x.columns if c != "content"]
        assert rows(x, *columns) == rows(y, *columns) and x.count() > 0
    log = spark.createDataFrame([(1, "add", 0.0, "a", None, "x", False, None), (2, "add", 0.0, None, "n", "x", False, None), (3, "add", 1.0, "b", "n", "", False, None)], EVENTS.replace("content", "identity"))
    assert [(r["id"], r["category"]) for r in ledger.resolve(log)[0].collect()] == [("b", "general")]
    asked = []
    monkeypatch.setattr(ledger, "resolve", lambda log, *a: asked.append(log.columns) or named)
    monkeypatch.setattr(scratch, "_made", {})
    QUERIES["supersession"](spark, SF)
    assert asked and "content" not in asked[0]
