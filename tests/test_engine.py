"""The store as an object: bases, tails, merges and prunes for good, documents that keep their scores."""

import json
import math
import time

import pytest

from tideline import rpc
from tideline.engine import Engine
from tideline.functions import model
from tideline.operators import ledger, strength
from tideline.sources import store


def test_adds_fold_nothing(spark):
    e = Engine(spark, in_memory=True, clock=lambda: 0.0)
    began = time.time()
    ids = [e.add(f"note number {i}") for i in range(300)]
    assert e.access(ids[7]) and e.add("note number 7") == ids[7] and e.retire(ids[8]) and not e.access(ids[8]) and not e._state
    assert time.time() - began < 5  # no job has run
    assert e.add("Note, number 9!") == e.get(ids[9])["id"] + "-2"
    assert e.size() == 301 and e.get(ids[7])["n_access"] == 2 and e.get(ids[8])["retired"]


def test_a_base_goes_on_as_the_log_would(spark):
    now = [0.0]
    one, two = (Engine(spark, in_memory=True, clock=lambda: now[0]) for _ in range(2))

    def both(f):
        assert f(one) == f(two)

    both(lambda e: [e.add("the lamp is lit", "task", memory_id="a"), e.add("a red fox", memory_id="b", protected=True), e.add("One, two!"), e.add("an old stone", memory_id="d")])
    both(lambda e: (e.access("a", 5.0), e.retire("d", "a")))
    now[0] = 3 * model.DAY
    two.compact()
    assert two._log.count() == 0 and two.base.count() == 4 and not two._gone
    now[0] = 9 * model.DAY
    both(lambda e: [e.add(" the lamp is lit "), e.add("one two"), e.access("a"), e.pin("a"), e.access("d"), e.retire("b"), e.pin("b"), e.add("a red fox", memory_id="z"), e.add("an old stone", memory_id="y"), e.add("new", supersedes="a")])
    for e in (one, two):
        with pytest.raises(ValueError):
            e.add("other", memory_id="d")
    rows = lambda e: {r["id"]: (r["n_access"], round(r["strength"], 7), r["pinned"], r["retired"], r["superseded_by"], r["last_access"], r["created"], r["tier"]) for r in e.state().collect()}
    assert rows(one) == rows(two) and rows(one)["d"][3:5] == (True, "a") and len(rows(one)) == 8


def test_refresh_merges_and_prunes_for_good(spark, tmp_path):
    """A loaded document holds a text twice; the merge stays, and a pruned row does not come back with an add of its text."""
    row = lambda i, text, score, **more: {"id": i, "content": text, "category": "general", "created": 1.0, "last_access": 2.0, "access_count": 3, "score": score, "score_at": 0.0} | more
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"schema": 3, "memories": [row("a", "x one", 0.05), row("b", "x one ", 0.3, created=4.0), row("c", "y", 0.02), row("d", "z", 0.04), row("e", "w", 0.5, retired=True, superseded_by="b")]}))
    now = [0.0]
    with Engine(spark, str(path), clock=lambda: now[0]) as e:
        assert {r["id"]: r["strength"] for r in e.state().collect()} == {"a": 0.05, "b": 0.3, "c": 0.02, "d": 0.04, "e": 0.5}
        assert e.get("e")["retired"] and e.get("e")["superseded_by"] == "b" and e.get("b")["n_access"] == 3 and e.get("b")["last_access"] == 2.0
        assert e.refresh(max_entries=3) == {"decayed": 0, "merged": 1, "pruned": 1, "prune_deficit": 0, "total": 3}
        assert sorted(r["id"] for r in e.state().collect()) == ["b", "d", "e"] and e.get("b")["n_access"] == 6 and e.get("b")["created"] == 1.0
        assert e.add("y", memory_id="c") == "c" and e.add("x one") == "b" and e.size() == 4
        e.save()
        now[0] = 10 * model.DAY
        kept = {r["id"]: r["strength"] for r in e.state().collect()}
    with Engine(spark, str(path), clock=lambda: now[0]) as e:
        assert {r["id"]: r["strength"] for r in e.state().collect()} == kept
        assert kept["d"] == pytest.approx(0.04 * math.exp(-0.3), abs=1e-9)


def test_pruned_rows_of_a_log_stay_away(spark):
    now = [0.0]
    e = Engine(spark, in_memory=True, clock=lambda: now[0])
    e.add("x one", memory_id="a")
    e.add("x one", memory_id="b")
    now[0] = 200 * model.DAY
    e.add("c", memory_id="c", protected=True)
    assert e.refresh(max_entries=1)["pruned"] == 1 and [r["id"] for r in e.state().collect()] == ["c"] and e.size() == 1


def test_unbounded_pool_and_batches(spark):
    e = Engine(spark, in_memory=True, clock=lambda: 0.0, recall_pool=0)
    for i in range(5):
        e.add(f"lamp {i}", memory_id=f"m{i}")
    assert len(e.recall(query="lamp").ranked_ids) == 5 and e.recall().ranked_ids == [f"m{i}" for i in range(5)]
    e.extend(spark.createDataFrame([(9, "add", 0.0, "n", "lamp 0", "general", False, None), (10, "add", 0.0, "o", "more", "general", False, None), (11, "retire", 0.0, "m1", None, None, False, "o")], model.EVENT))
    assert e.get("m0")["n_access"] == 1 and e.get("m1")["superseded_by"] == "o" and not e.access("m1") and e.access("o") and e.add("more") == "o"
    with pytest.raises(ValueError):
        e.add("p", memory_id="o")
    assert e.size() == 6 and e.get("o")["n_access"] == 2


def test_retire_names_its_replacement_over_rpc(spark):
    s = rpc.Server(Engine(spark, in_memory=True, clock=lambda: 0.0))
    call = lambda name, **a: json.loads(s.line(json.dumps({"jsonrpc": "2.0", "id": "k", "method": "tools/call", "params": {"name": name, "arguments": a}})))
    made = json.loads(call("memory_add", content="The lamp is lit.", category="task")["result"]["content"][0]["text"])["id"]
    assert not call("memory_retire", id=made, superseded_by="later")["result"]["isError"]
    assert s.engine.get(made)["superseded_by"] == "later"
    for bad in ({"id": made, "superseded_by": 3}, {"id": made, "other": 1}, {"id": True}, {}, {"id": made, "superseded_by": " "}):
        assert call("memory_retire", **bad)["error"]["code"] == -32602
    for bad in ({"max_entries": True}, {"max_entries": 1.0}, {"max_entries": -1}):
        assert call("memory_refresh", **bad)["error"]["code"] == -32602
    assert call("nothing")["error"]["code"] == -32602
    assert json.loads(s.line('{"jsonrpc":"2.0","id":[1],"method":"ping"}'))["error"]["code"] == -32600
    assert json.loads(s.line('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":[]}'))["error"]["code"] == -32602
    assert json.loads(s.line('{"jsonrpc":"2.0","id":null,"method":"ping"}'))["result"] == {} and s.line("  ") is None
    listed = {t["name"]: t["inputSchema"] for t in json.loads(s.line('{"jsonrpc":"2.0","id":1,"method":"tools/list"}'))["result"]["tools"]}
    assert len(listed) == 7 and listed["memory_retire"]["required"] == ["id"] and listed["memory_recall"]["properties"]["budget"]["minimum"] == 0


def test_incremental_fold_reads_new_events_only(spark):
    m = spark.createDataFrame([(f"m{i}", "t", "task", 0.0) for i in range(20)], "id string, content string, category string, created double")
    rows = [(i, f"m{i % 13}", ["access", "access", "pin", "retire"][i % 17 % 4], i * 5000.0) for i in range(120)]
    e = spark.createDataFrame(rows, "seq long, id string, op string, ts double")
    half, end = 60 * 5000.0 - 1, 130 * 5000.0
    carried = strength.snapshot_of(strength.fold(m, e.where(f"ts <= {half}"), half, exact=True), half, "content", "category", "created")
    got = strength.fold(carried, e.where(f"ts > {half}"), end)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, strength.fold(m, e, end).collect()))


def test_a_base_as_ledger_rows(spark):
    base = store.base_of(spark.createDataFrame([("m-1", "One", "", "general", 0.0, 0.0, 0, 0.6, 0.0, False, "active", False, None)], model.MEMORY))
    log = spark.createDataFrame([(0, "add", 1.0, None, "one", "general", False, None)], model.EVENT)
    rows, _ = ledger.resolve(log, True, base)
    assert rows.count() == 2 and ledger.resolve(log.limit(0), True, base.limit(0))[0].count() == 0
