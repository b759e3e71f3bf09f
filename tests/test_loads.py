"""Loads: broken ones are not seen and resume, repeated ones do nothing, small ones write little."""

import os

import pytest
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators import loads, refresh, tables
from quarry.sources import catalogue, ledger


def components(spark, low, high, stock=1):
    rows = [(f"C{i}", f"N-{i}", f"maker {i % 17}", ["Passive", None][i % 2], ["R", None, "C"][i % 3], f"part {i} usb" if i % 5 == 0 else "part", f"pkg{i % 9}", f"https://d.example.com/{i % 40}" if i % 4 else None, stock + i, str(i), 1, f'{{"attributes": {{"Resistance": "{i}Ω", "Color": "c{i % 6}"}}}}' if i % 10 else "junk") for i in range(low, high)]
    rows.append(("C0", " ", "nobody", None, None, None, None, None, 1, None, 0, None))
    return spark.createDataFrame(rows, "lcsc string, mpn string, manufacturer string, category string, subcategory string, description string, package string, datasheet string, stock long, price string, is_basic int, extra string")


def state(tables_: dict[str, DataFrame]):
    return {k: sorted(map(str, v.select(*sorted(v.columns)).collect())) for k, v in tables_.items()}


def plain(spark, *steps):
    """The tables by whole merges."""
    out = None
    for rows, ref in steps:
        made = tables.entity_tables(tables.normalise(catalogue.staged(rows), ref))
        out = made if out is None else tables.merge(out, made)
    return out


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-") and "/loads/" in d and "/normalised" not in d}


def test_loads_merge_and_repeat(spark, tmp_path):
    store = loads.Store(spark, f"{tmp_path}/s")
    assert store.read() == {} and store.loads() == set()
    first, second, third = components(spark, 1, 400), components(spark, 395, 399, 1000), components(spark, 300, 600, 7)
    seen = Observation()
    got = store.load(catalogue.staged(first, seen=seen), "a", "ra", seen)
    assert got["parts_loaded"] == 399 and (got["skipped_empty_mpn"], got["corrupt_extra"]) == (1, 39) and not got["repeated"]
    assert state(store.read()) == state(plain(spark, (first, "ra")))
    before = files(f"{tmp_path}/s")
    store.load(catalogue.staged(second), "b", "rb")  # one in a hundred
    small = files(f"{tmp_path}/s") - before
    assert state(store.read()) == state(plain(spark, (first, "ra"), (second, "rb")))
    rewritten = {t: sum(r["rows"] for r in store.manifest()[1] if r["table"] == t and "-b/" in r["path"]) for t in loads.KEYS}
    assert rewritten["part"] == 4 and before <= files(f"{tmp_path}/s") and not any("whole" in f for f in small)
    assert len([r for r in store.manifest()[1] if r["table"] == "tagged" and "-b/" in r["path"]]) == 0  # edges that were there make no rows
    now = state(store.read())
    assert store.load(catalogue.staged(second), "b", "rb")["repeated"] and state(store.read()) == now and store.manifest()[0] == 2
    store.load(catalogue.staged(third), "c", "rc")  # many: its tables become one folder again
    assert state(store.read()) == state(plain(spark, (first, "ra"), (second, "rb"), (third, "rc")))
    assert [r["path"] for r in store.manifest()[1] if r["table"] == "part"] == ["loads/3-c/part-whole"]
    assert {r["type"]: r["n"] for r in tables.node_counts(store.read()).collect()} == store.node_counts() and store.loads() == {"a", "b", "c"}


def test_broken_load_is_not_seen_and_resumes(spark, tmp_path, monkeypatch):
    store = loads.Store(spark, f"{tmp_path}/s")
    first, second = components(spark, 1, 60), components(spark, 50, 90, 500)
    store.load(catalogue.staged(first), "a", "ra")
    whole, real = state(store.read()), loads.Store._once

    def breaks(self, path, make):
        if path.endswith("/tag"):  # the write starts and its task dies
            bad = F.raise_error(F.lit("lost")).cast("string")
            return real(self, path, lambda: make().withColumn("name", F.when(F.col("name").isNotNull() | F.lit(True), bad)))
        return real(self, path, make)

    monkeypatch.setattr(loads.Store, "_once", breaks)
    with pytest.raises(Exception, match="lost"):
        store.load(catalogue.staged(second.union(components(spark, 100, 101).withColumn("description", F.lit("rs232")))), "b", "rb")
    assert state(store.read()) == whole and store.loads() == {"a"}
    done = {f for f in files(f"{tmp_path}/s") if "/2-b/" in f}
    assert done
    monkeypatch.setattr(loads.Store, "_once", real)
    store.load(catalogue.staged(components(spark, 0, 0)), "b", "rb")  # its rows were written down before it broke
    assert done <= files(f"{tmp_path}/s")
    want = plain(spark, (first, "ra"), (second.union(components(spark, 100, 101).withColumn("description", F.lit("rs232"))), "rb"))
    assert state(store.read()) == state(want)


def test_names_of_loads(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        loads.Store(spark, f"{tmp_path}/s").load(components(spark, 1, 2), "../x", "r")


def test_empty_load(spark, tmp_path):
    store = loads.Store(spark, f"{tmp_path}/s")
    store.load(catalogue.staged(components(spark, 0, 0)), "none", "r")
    assert all(not v for v in state(store.read()).values())
    store.load(catalogue.staged(components(spark, 1, 5)), "some", "r")
    assert store.node_counts()["part"] == 4


def test_summaries_are_taken_while_writing(spark, tmp_path):
    """The figures of a refresh come from the write itself: one scan, no second pass."""
    parts = spark.createDataFrame([("C1", 5, 1.0, True, None), ("C2", 5, 1.0, True, None), (None, 5, 1.0, True, None)], "lcsc_id string, stock long, price_usd double, is_basic boolean, stock_checked_at timestamp")
    source = spark.createDataFrame([("C1", 7, 2.0, False, 1)], "lcsc_id string, stock long, price_usd double, is_basic boolean, pos long")
    out = refresh.stock_write_back(parts, source, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    got = ledger.write_observed(out, f"{tmp_path}/w", **refresh.stock_figures())
    assert got == {"rows": 3} | refresh.stock_summary(spark.read.parquet(f"{tmp_path}/w")).first().asDict()
    sheets = spark.createDataFrame([("http://a.com", None, None, 2), ("http://b.com", None, None, 0), ("http://c.com", None, None, 1)], "url string, verified_at timestamp, http_status int, fail_count int")
    edges = spark.createDataFrame([("x", "http://a.com"), ("y", "http://b.com")], "xid string, url string")
    checks = spark.createDataFrame([("http://a.com", 500), ("http://b.com", 200), ("http://b.com", 500)], "url string, status int")
    kept, left, purged, figures = refresh.write_links(sheets, edges, checks, F.lit("2024-01-20 00:00:00").cast("timestamp"), f"{tmp_path}/l")
    want = refresh.link_write_back(sheets, edges, checks, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    for a, b in zip((kept, left, purged), want, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert figures == refresh.link_summary(sheets, checks, want[2]).first().asDict()
