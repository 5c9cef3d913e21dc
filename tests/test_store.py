import json

import pytest

from tideline.sources import store


def _doc(path, **over):
    row = {"id": "m1", "content": "A text. And more.", "category": "general", "created": 5.0, "last_access": 7.0, "access_count": 1, "score": 0.6}
    path.write_text(json.dumps({"schema": 2, "memories": [row]} | over))
    return f"file://{path}"


def test_older_store_is_migrated_and_written_again(spark, tmp_path):
    m = store.read_json(spark, _doc(tmp_path / "s.json"))
    r = m.first()
    assert (r["score_at"], r["tier"], r["retired"], r["summary"]) == (7.0, "active", False, "A text. And more.")
    store.write_json(m, str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text())["schema"] == 3
    assert store.read_json(spark, f"file://{tmp_path}/t.json").first()["id"] == "m1"


@pytest.mark.parametrize("schema", [99, True, "x"])
def test_bad_versions_are_refused(spark, tmp_path, schema):
    with pytest.raises(ValueError):
        store.read_json(spark, _doc(tmp_path / "s.json", schema=schema))


def test_one_owner(tmp_path):
    path = str(tmp_path / "s.json")
    with store.Owner(path), pytest.raises(RuntimeError):
        store.Owner(path)
    store.Owner(path).close()
