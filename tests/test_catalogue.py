"""Catalogue operators against the fixture tables and DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import exprs
from quarry.operators import enrich, refresh, search
from quarry.plans import catalogue_queries
from quarry.sources import catalogue, ledger
from quarry.streaming.ingest import ingest
from quarry.streaming.links import CHECKS, COUNTS, carried, count_failures

SF = "/root/testdata/sf0.001"
UNITS = [("5V", 5.0), ("3.3V", 3.3), ("12VDC", 12.0), ("100nF", 1e-7), ("10uF", 1e-5), ("4.7µF", 4.7e-6), ("10kΩ", 1e4), ("10k", 1e4), ("2.2M", 2.2e6), ("500mA", 0.5), ("2.5A", 2.5), ("1MHz", 1e6), ("50Hz", 50.0), ("100ns", 1e-7), ("10µH", 1e-5), ("0.25W", 0.25), ("1%", 1.0), ("±1%", 1.0), ("±100ppm/℃", 100.0), ("1V~5V", None), ("2V@1mA", 2.0), ("abc", None), ("", None), (None, None)]


def test_units(spark):
    rows = spark.createDataFrame(UNITS, "t string, v double").select("v", exprs.magnitude(F.col("t")).alias("got")).collect()
    for r in rows:
        assert r["got"] == (pytest.approx(r["v"]) if r["v"] is not None else None)


def test_enrich_and_promote(spark):
    rows = [(1, 0, "Operating Temperature", "-55℃~+155℃"), (1, 1, "Supply Voltage", "1.8V;3.3V"), (1, 2, "Overload Voltage (Max)", "75V"), (1, 3, "Output Current (ours)", "1A~3A")]
    rich = enrich.enrich(spark.createDataFrame(rows, "k long, pos int, name string, value_text string"))
    got = {(r["pos"], r["sub_pos"]): (r["name"], r["value_num"]) for r in rich.collect()}
    assert got[0, 1] == ("Operating Temperature (min)", -55.0) and got[0, 2][1] == 155.0 and got[0, 0][1] is None
    assert [got[1, i][1] for i in range(3)] == [None, 1.8, 3.3]
    out = enrich.promote(rich, "k").first()
    assert (out["voltage_max"], out["current_max"], out["voltage_min"]) == (75.0, 1.0, None)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, 1.0, ["a"]), (2, None, None)], "k long, v double, refs array<string>")
    new = spark.createDataFrame([(2, 5.0, ["b"]), (3, None, ["c"])], "k long, v double, refs array<string>")
    once = enrich.upsert(old, new, "k", sets=("refs",))
    assert sorted(once.collect()) == sorted(enrich.upsert(once, new, "k", sets=("refs",)).collect())
    assert {r["k"]: r["v"] for r in once.collect()} == {1: 1.0, 2: 5.0, 3: None}


def test_shapes(spark):
    flat = spark.createDataFrame([("C1", "max232", "TI"), ("C2", " ", "TI")], "lcsc string, mpn string, manufacturer string")
    assert [r["xid"] for r in catalogue.staged(flat).collect()] == ["MAX232|TI"]
    keyed = spark.createDataFrame([(7, "", 1, 9, '{"mpn": "ab-1"}')], "lcsc int, mfr string, manufacturer_id int, category_id int, extra string")
    makers, cats = spark.createDataFrame([(1, "Acme")], "id int, name string"), spark.createDataFrame([(1, "x", "y")], "id int, category string, subcategory string")
    row = catalogue.staged(keyed, makers, cats).first()
    assert (row["lcsc_id"], row["xid"], row["category"]) == ("C7", "AB1|ACME", None)
    with pytest.raises(ValueError):
        catalogue.staged(flat.select("lcsc"))


def test_links_and_sanity(spark):
    urls = {"ftp://a.com": False, "http://127.0.0.1/x": False, "http://2130706433": False, "http://127.1": False, "http://0": False, "http://[::1]/": False, "https://lcsc.com/a": True, "http://8.8.8.8": True, "http://192.0.0.9": True, "http://100.64.0.1": True, None: False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", exprs.checkable(F.col("u")).alias("ok")).collect()
    assert {r["u"]: r["ok"] for r in rows} == urls
    got = spark.createDataFrame([(x,) for x in (-0.01, 0.0, 1e6, 1e6 + 1, float("nan"), float("inf"), None)], "p double").select(exprs.sane(F.col("p"), F.lit(-1.0), 1e6).alias("p")).collect()
    assert [r["p"] for r in got] == [-1, 0, 1e6, -1, -1, -1, -1]


def test_sort_argument(spark):
    hits, parts = spark.createDataFrame([], "query_id long, xid string, tier string"), catalogue.parts(spark, SF)
    with pytest.raises(ValueError):
        search.ranked(hits, parts, sort="newest")
    assert refresh.first_per(parts, "xid", "mpn").count() == parts.count()


def test_stream_adds_nothing_twice(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    (src / "a.json").write_text('{"k": 1, "seq": 1, "v": "old"}\n{"k": 2, "seq": 1, "v": "x"}\n')
    ingest(spark, str(src), "k long, seq long, v string", state, "k", "seq")
    (src / "b.json").write_text('{"k": 1, "seq": 2, "v": "new"}\n')
    for _ in range(2):
        ingest(spark, str(src), "k long, seq long, v string", state, "k", "seq")
    assert sorted(p for p in os.listdir(state) if p.startswith("snapshot")) == ["snapshot-0", "snapshot-1"]
    assert {r["k"]: r["v"] for r in spark.read.parquet(f"{state}/snapshot-1").collect()} == {1: "new", 2: "x"}


def test_failures_are_carried(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    runs = [
        [(1, 1, False), (1, 2, False), (2, 1, False), (2, 2, True), (2, 3, False), (4, 1, True), (None, 1, False), (5, 1, None)],
        [(1, 3, False), (1, 3, False), (2, 3, False), (2, 2, True), (3, 1, False), (4, 2, False)],
        [(1, 4, True), (1, 5, False), (3, 2, False), (3, 3, True)],
    ]
    want = [{1: 2, 2: 1, 4: 0}, {1: 3, 2: 1, 3: 1, 4: 1}, {1: 1, 2: 1, 3: 0, 4: 1}]
    for i, checks in enumerate(runs):
        (src / f"{i}.json").write_text("".join(json.dumps(dict(zip(("url_id", "seq", "alive"), c, strict=True))) + "\n" for c in checks))
        for _ in range(2):
            count_failures(spark, str(src), state)
        assert {r["url_id"]: r["fail_count"] for r in spark.read.parquet(f"{state}/snapshot-{i}").collect()} == want[i]
    assert not os.path.exists(f"{state}/snapshot-3")
    every = refresh.fail_counts(spark.createDataFrame([c for r in runs for c in r if None not in c], CHECKS).distinct())
    assert {r["url_id"]: r["fail_count"] for r in every.collect()} == want[-1]
    assert carried(spark.createDataFrame([], COUNTS), spark.createDataFrame([], CHECKS)).count() == 0


def test_prices(spark):
    prices = {"0.5": 0.5, "[]": None, '[{"price": 0.1}]': 0.1, '[{"usd": "0.2"}]': 0.2, '[{"price": true}, {"Price": 3}]': 3.0, '[{"price": "x", "Price": 2}]': 2.0, "{}": None, "garbage": None, "": None, "[1, 2]": None, None: None}
    rows = spark.createDataFrame([(p,) for p in prices], "p string").select("p", exprs.tier_price(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in rows} == prices


def test_query_text(spark):
    want = {
        "10k 0402 1%": ([("resistance", 10000.0), ("tolerance_pct", 1.0)], "0402", []), "1.2V MAX232": ([("voltage_max", 1.2)], None, ["MAX232"]),
        "5Z 10000 1V~5V 2V@1mA": ([], None, ["5Z", "10000", "1V~5V", "2V@1mA"]), "sot-23 0402 --": ([], "SOT-23", ["0402"]), "100µF 50Hz": ([("capacitance", 100 * 1e-6), ("frequency_max", 50.0)], None, []),
        " ": ([], None, []), None: ([], None, []), "a " * 30: ([], None, ["a"] * 10),
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", exprs.parse_query(F.col("q")).alias("p")).collect()
    for r in rows:
        quantities, package, words = want[r["q"]]
        assert [x["parameter"] for x in r["p"]["quantities"]] == [p for p, _ in quantities]
        assert [x["value"] for x in r["p"]["quantities"]] == pytest.approx([v for _, v in quantities])
        assert (r["p"]["package"], r["p"]["words"]) == (package, words)


def test_related_and_nearest(spark):
    numbers = ["MAX232", "MAX233", "XMAX1", "1N4148", "1N41", "A", ""]
    parts = spark.createDataFrame([(n, n) for n in numbers], "xid string, mpn_norm string")
    got = {}
    for r in sorted(search.related(parts, 2).collect()):
        got.setdefault(r["xid"], []).append(r["related"])
    assert got["MAX232"] == ["MAX233", "XMAX1"] and got["MAX233"] == ["MAX232", "XMAX1"] and got["1N41"] == ["1N4148"]
    assert got["A"] == ["MAX232", "MAX233"] and "" not in got and "XMAX1" not in got
    ids = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "query_id long, xid string")
    targets = spark.createDataFrame([(1, "power", 2.0), (2, "power", 1.0)], "query_id long, parameter string, target double")
    values = spark.createDataFrame([("a", "power", 1.0), ("b", "power", 2.5)], "xid string, parameter string, value double")
    rows = search.nearest(targets, ids, ids.where("query_id = 2"), values).orderBy("rank").collect()
    assert [(r["query_id"], r["xid"], r["distance"]) for r in rows] == [(1, "c", 0.0), (1, "b", 0.5), (1, "a", 1.0)]


def test_result_json(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 3.0)], "query_id long, rank int, xid string, price_usd double")
    assert json.loads(search.result_json(rows, ["xid", "price_usd"]).first()["json"]) == {"version": 1, "count": 2, "results": [{"xid": "a", "price_usd": 3.0}, {"xid": "b"}]}


def test_ledger(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("{}")
    first = spark.createDataFrame(ledger.fingerprints(spark, str(src)).collect())
    (src / "b.json").write_text("{}")
    assert [r["path"][-6:] for r in ledger.unseen(ledger.fingerprints(spark, str(src)), first).collect()] == ["b.json"]
    got = ledger.write_measured(spark.range(7).toDF("k"), str(tmp_path / "out"))
    assert got["parts_loaded"] == 7 and spark.read.parquet(str(tmp_path / "out")).count() == 7


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue_queries.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalogue_queries.QUERIES[name](spark, SF), con.sql(catalogue_queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    rows = lambda rs, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in rs), key=str)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
