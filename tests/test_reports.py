"""Reports of replays: full and scoped ones beside each other."""

import json

import pytest

from tideline.sources import reports

COLS = "arm string, qid string, used array<string>, ranked array<string>, evidence array<string>, stale array<string>, chars long, budget long, kind string, source string, note string"


def records(spark, *rows):
    return spark.createDataFrame([(arm, qid, used, used, evidence, [], 100, 200, kind, "made", None) for arm, qid, used, evidence, kind in rows], COLS)


def section(text, name):
    """The table under a heading, as a row a line."""
    table = text.split(f"## {name}\n\n")[1].split("\n\n")[0].split("\n")
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in table]
    return [dict(zip(cells[0], c, strict=True)) for c in cells[2:]]


def test_report_says_what_was_found(spark, tmp_path):
    r = records(spark, ("M1", "q1", ["a", "b"], ["b"], "x"), ("M1", "q2", ["a"], ["c"], "y"), ("M2", "q1", ["b"], ["b"], "x"), ("M2", "q2", None, None, "y"))
    folder = f"file://{tmp_path}/out"
    at = reports.write(r, folder)
    text = reports.read(spark, folder)
    rows = section(text, "All: what was found")
    assert [(x["arm"], x["queries"], x["scored_queries"], x["hit_rate"], x["mrr"]) for x in rows] == [("M1", "2.000", "2.000", "0.500", "0.250"), ("M2", "2.000", "1.000", "1.000", "1.000")]
    assert {(x["value"], x["arm"], x["hit_rate"]) for x in section(text, "By kind: what was found")} == {("x", "M1", "1.000"), ("x", "M2", "1.000"), ("y", "M1", "0.000"), ("y", "M2", "0.000")}
    assert [(x["arm"], x["mean_chars"], x["budget_utilisation"], x["chars_per_hit"]) for x in section(text, "All: what it cost")] == [("M1", "100.000", "0.500", "200.000"), ("M2", "100.000", "0.500", "100.000")]
    raw = [json.loads(x["value"]) for x in spark.read.text(f"{at}/records").collect()]
    assert sorted((x["arm"], x["qid"], x["used"]) for x in raw if x["used"]) == [("M1", "q1", ["a", "b"]), ("M1", "q2", ["a"]), ("M2", "q1", ["b"])]
    assert len(raw) == 4 and all("note" in x for x in raw)


def test_a_part_leaves_the_full_report_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    reports.write(records(spark, ("M1", "q1", ["a"], ["a"], "x")), folder)
    full = reports.read(spark, folder)
    reports.write(records(spark, ("M2", "q9", ["a"], ["z"], "x")), folder, scope="kind-x")
    assert reports.read(spark, folder) == full and reports.read(spark, folder, "kind-x") != full
    assert spark.read.json(f"{reports.place(folder)}/records").select("qid").collect()[0][0] == "q1"
    again = records(spark, ("M2", "q9", ["z"], ["z"], "x"))
    reports.write(again, folder, scope="kind-x")
    assert section(reports.read(spark, folder, "kind-x"), "All: what was found")[0]["hit_rate"] == "1.000"
    for bad in ("", "a/b", "../full", "a b"):
        with pytest.raises(ValueError):
            reports.write(again, folder, scope=bad)
    with pytest.raises(ValueError):
        reports.write(again, folder, ("arm",))


def test_a_run_of_nothing_has_headings_only(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    reports.write(records(spark, ("M1", "q1", ["a"], ["a"], "x")).limit(0), folder, ("kind",), title="Empty")
    text = reports.read(spark, folder)
    assert text.startswith("# Empty\n") and section(text, "All: what was found") == [] and "## By kind: what it cost" in text
