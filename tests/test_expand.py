"""One-hop expansion, first rows of keys and the scratch folder, on small fixtures."""

import types

import pytest

from quarry import staging
from quarry.operators import refresh, search


def test_expanded(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "made_by": t([("a", "Zed"), ("a", "Acme"), ("a", "Acme"), ("z", "Other")], "xid string, name string"),
        "in_category": t([("a", "Passive", "Resistors"), ("a", None, "Loose")], "xid string, parent_name string, name string"),
        "in_package": t([("a", "0402")], "xid string, name string"),
        "tagged": t([], "xid string, name string"),
        "datasheet_of": t([("a", "https://b"), ("a", "https://a"), ("b", "https://gone")], "xid string, url string"),
        "datasheet": t([("https://a", 200, 0), ("https://b", 404, 2)], "url string, http_status int, fail_count int"),
    }
    rows = t([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("c", 4, "x"), (None, 5, "x")], "xid string, n int, tags string")
    out = {r["n"]: r for r in search.expanded(rows, tables).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and out[1]["makers"] == out[2]["makers"] == ["Acme", "Zed"]
    assert (out[1]["categories"], out[1]["packages"], out[1]["tags"]) == (["Loose", "Passive > Resistors"], ["0402"], [])
    assert [tuple(s) for s in out[1]["sheets"]] == [("https://a", 200, 0), ("https://b", 404, 2)]
    assert [tuple(s) for s in out[3]["sheets"]] == [("https://gone", None, None)] and out[3]["makers"] == []
    assert all(out[n][k] == [] for n in (4, 5) for k in (*search.REACHED, "sheets"))
    assert search.expanded(rows.limit(0), tables).count() == 0


def test_first_per(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 5, None), ("b", None, "z"), (None, 3, "q"), (None, 4, "q")]
    out = refresh.first_per(spark.createDataFrame(rows, "key string, row int, `v.w` string"), "key", "row")
    assert out.columns == ["key", "row", "v.w"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, "y"), ("b", None, "z"), (None, 3, "q")], key=str)


def test_scratch_is_shared():
    def session(master, *, known):
        context = types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(contains=lambda k: known))
        return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: "file:/tmp/w"))

    assert staging._warehouse(session("local[2]", known=False)) == staging._warehouse(session("spark://h:7077", known=True)) == "file:/tmp/w"
    with pytest.raises(ValueError):
        staging._warehouse(session("spark://h:7077", known=False))
