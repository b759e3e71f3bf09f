"""Ingest, write-backs, embeddings, the search verb and the SQLite source on small fixtures."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import exprs
from quarry.operators import embed, enrich, graph, refresh, search, tables
from quarry.sources import catalogue, sqlite

EXTRAS = [
    ('{"mpn": "AB-1", "attributes": {"Resistance": "10kΩ", "Supply Voltage": {"primary": "1.8V;3.3V", "values": {"k": [1, "V"]}}, "odd": [1], "n": 3, "b": true}}', False),
    ("not json", True), ("[1,2]", True), ("", False), (None, False), ('{"attributes": [1]}', False),
]


def test_extra(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(EXTRAS)], "i int, x string")
    got = rows.select("i", exprs.corrupt(F.col("x")).alias("c"), exprs.extra(F.col("x"))["mpn"].alias("m"), exprs.attribute_records(exprs.extra(F.col("x"))["attributes"]).alias("a")).orderBy("i").collect()
    assert [r["c"] for r in got] == [c for _, c in EXTRAS] and got[0]["m"] == "AB-1"
    assert [tuple(a) for a in got[0]["a"]] == [("Resistance", "10kΩ"), ("Supply Voltage", "1.8V;3.3V")] and not any(r["a"] for r in got[1:])


def staged(spark):
    raw = spark.createDataFrame(
        [(7, "", 1, 9, EXTRAS[0][0], "5", 3.0), (8, "x1", 5, 1, "oops", '[{"price": 2}]', None), (9, " ", None, None, "[1]", None, 1.0)],
        "lcsc int, mfr string, manufacturer_id int, category_id int, extra string, price string, stock double",
    )
    makers, kinds = spark.createDataFrame([(1, "Acme")], "id int, name string"), spark.createDataFrame([(1, "Passive", "Resistors")], "id int, category string, subcategory string")
    return raw, makers, kinds


def test_staged_and_quality(spark):
    parts = {r["lcsc_id"]: r for r in catalogue.staged(*staged(spark)).collect()}
    assert set(parts) == {"C7", "C8"} and parts["C7"]["xid"] == "AB1|ACME" and parts["C7"]["stock"] == 3 and parts["C8"]["price_usd"] == 2.0
    assert parts["C8"]["category"] == "Passive" and parts["C8"]["datasheet_url"] is None
    assert tuple(catalogue.quality(*staged(spark)).first()) == (1, 2, 2)


def test_normalise_export_and_load_twice(spark, tmp_path):
    rows = tables.normalise(catalogue.staged(*staged(spark)).withColumn("description", F.lit("an RS232 and usb part")), "first")
    part = {r["lcsc_id"]: r for r in rows.collect()}["C7"]
    assert part["promoted"] == {"resistance": 1e4} and part["tags"] == ["RS-232", "USB"] and part["source_ref"] == "first"
    assert [(a["name"], a["value_text"], a["value_num"], a["unit"]) for a in part["attributes"]][1:] == [("Supply Voltage", "1.8V;3.3V", None, None), ("Supply Voltage", "1.8V", 1.8, "V"), ("Supply Voltage", "3.3V", 3.3, "V")]
    seeded = rows.withColumn("promoted", F.create_map(F.lit("resistance"), F.lit(1.0)))
    assert tables.normalise(seeded, "x").first()["promoted"]["resistance"] == 1.0

    catalogue.write_staged(rows, f"{tmp_path}/a")
    back = catalogue.read_staged(spark, f"{tmp_path}/a")
    assert sorted(map(str, back.select(*catalogue.STAGED).collect())) == sorted(map(str, rows.select(*catalogue.STAGED).collect()))
    lines = [json.loads(x) for f in sorted((tmp_path / "a").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["lcsc_id"] for x in lines] == ["C7", "C8"] and all(list(x) == sorted(x) for x in lines)
    assert [r["lcsc_id"] for r in catalogue.first_parts(rows, 1).collect()] == ["C7"]

    loads = catalogue.staged(*staged(spark))
    assert tables.ingest(loads, "first", f"{tmp_path}/1")["parts_loaded"] == 2
    for i, ref in ((2, "second"), (3, "second")):
        tables.ingest(loads.where("lcsc_id = 'C8'"), ref, f"{tmp_path}/{i}", f"{tmp_path}/{i - 1}")
    two, three = tables.read(spark, f"{tmp_path}/2"), tables.read(spark, f"{tmp_path}/3")
    for k in (*tables.NODES, *tables.EDGES):
        assert sorted(map(str, two[k].collect())) == sorted(map(str, three[k].collect())), k
    assert {r["lcsc_id"]: r["source_refs"] for r in three["part"].collect()} == {"C7": ["first"], "C8": ["first", "second"]}
    assert {r["type"]: r["n"] for r in tables.node_counts(three).collect()}["category"] == 2
    assert [tuple(r) for r in graph.hierarchy(three["category"]).collect()] == [("Passive", "Resistors")]


def test_stock_write_back(spark):
    parts = spark.createDataFrame([("C1", 5, 1.0, True, None), ("C2", 5, 1.0, True, None), (None, 5, 1.0, True, None)], "lcsc_id string, stock long, price_usd double, is_basic boolean, stock_checked_at timestamp")
    source = spark.createDataFrame([("C1", 7, 2.0, False, 1), ("C1", 9, float("nan"), False, 2), (None, 1, 1.0, True, 3)], "lcsc_id string, stock long, price_usd double, is_basic boolean, pos long")
    out = refresh.stock_write_back(parts, source, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    got = {r["lcsc_id"]: r for r in out.collect()}
    assert (got["C1"]["stock"], got["C1"]["price_usd"], got["C1"]["is_basic"], got["C1"]["outcome"]) == (9, 1.0, False, "matched")
    assert got["C2"]["is_basic"] and got["C2"]["stock_checked_at"] is not None and got[None]["stock_checked_at"] is None
    assert tuple(refresh.stock_summary(out).first()) == (2, 1, 1)


def test_link_status_and_addresses(spark):
    rows = [("http://a.com", 200, True, 200), ("http://a.com", 399, True, 399), ("http://a.com", 400, False, 400), ("http://a.com", None, False, 0), ("http://127.0.0.1", 200, False, 0), ("http://[2606:4700::1111]/x", 200, True, 200), ("http://[::ffff:127.0.0.1]", 200, False, 0), ("http://[2001:db8::1]", 200, False, 0)]
    got = spark.createDataFrame(rows, "u string, s int, a boolean, h int").select("a", "h", exprs.link_status(F.col("u"), F.col("s")).alias("c")).collect()
    assert all((r["c"]["alive"], r["c"]["http_status"]) == (r["a"], r["h"]) for r in got)


def test_reconcile(spark):
    schema = "xid string, description string, category string, package string, tags array<string>, embedding array<float>, embed_text_hash string"
    rows = spark.createDataFrame([("a", "new part", None, None, None, None, None), ("b", "old part", None, None, None, [0.0, 1.0], None), ("c", "", None, None, None, None, None), ("d", "changed", None, None, None, [1.0, 0.0], "stale")], schema)
    assert embed.any_embedded(rows) and not embed.any_embedded(rows.where("xid = 'a'"))
    out, summary = embed.reconcile(rows, embed.hashing_encoder(2), 2)
    got = {r["xid"]: r for r in out.collect()}
    assert got["a"]["embedding"] is not None and got["b"]["embedding"] == [0.0, 1.0] and got["b"]["embed_text_hash"] and got["c"]["embedding"] is None and got["d"]["embed_text_hash"] != "stale"
    assert tuple(summary.first()) == (2, 1, 1)
    again, _ = embed.reconcile(out, embed.hashing_encoder(2), 2)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    with pytest.raises(Exception, match="width 3"):
        embed.reconcile(rows, embed.hashing_encoder(2), 3)[0].collect()


def test_arguments():
    for bad in ({"sort": "name"}, {"terms_": (" ",)}, {"terms_": ("x" * 129,)}, {"min_stock": -1}, {"min_stock": True}, {"max_price": float("nan")}):
        with pytest.raises(ValueError):
            search.check(**bad)
    assert search.clamp(0) == 1 and search.clamp(1000) == 200


def test_zero_and_equal_parameters(spark):
    values = spark.createDataFrame([("a", "resistance", 0.0), ("b", "resistance", 100.0), ("b", "tolerance_pct", 1.0), ("c", "resistance", 100.5), ("c", "tolerance_pct", 5.0)], "xid string, parameter string, value double")
    asked = spark.createDataFrame([(1, "resistance", 0.0), (2, "resistance", 100.0), (2, "tolerance_pct", 1.0), (3, "resistance", 100.0), (4, "resistance", -5.0)], "query_id int, parameter string, target double")
    assert sorted(map(tuple, search.parametric(asked, values).collect())) == [(1, "a"), (2, "b"), (3, "b"), (3, "c")]


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/c.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE components (lcsc INTEGER, mfr TEXT, weight REAL)")
    db.executemany("INSERT INTO components VALUES (?, ?, ?)", [(i, f"part {i}", i / 2) for i in range(2500)])
    db.execute("DELETE FROM components WHERE lcsc BETWEEN 100 AND 1400")
    db.commit()
    db.close()
    sqlite.register(spark)
    rows = spark.read.format("quarry_sqlite").option("path", path).option("table", "components").option("rows", "700").load()
    assert dict(rows.dtypes) == {"lcsc": "bigint", "mfr": "string", "weight": "double"}
    assert rows.rdd.getNumPartitions() == 2 and tuple(rows.agg(F.count("*"), F.sum("lcsc"), F.max("mfr")).first()) == (1199, sum(range(2500)) - sum(range(100, 1401)), "part 99")


def test_promoted_agrees_with_rows(spark):
    rows = spark.createDataFrame([(1, 0, "Current", "1A~3A"), (1, 1, "Current", "9A"), (1, 2, "Resistance", "x"), (1, 3, "Resistance", "5Ω;6Ω")], "k int, pos int, name string, value_text string")
    by_row = enrich.promote(enrich.enrich(rows), "k").first()
    one = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value_text"))).alias("a")).select(enrich.promoted(F.flatten(F.transform("a", lambda a: enrich.enriched(a["name"], a["value_text"])))).alias("m")).first()["m"]
    assert one == {"current_max": 1.0, "resistance": 5.0} and by_row["current_max"] == 1.0 and by_row["resistance"] == 5.0


def test_search_verb_and_documents(spark):
    parts = spark.createDataFrame(
        [("A1|X", "A-1", "A1", "blue ring widget", "X", "0402", "Passive", 5, True, 1.0, 10000.0), ("A12|X", "A-12", "A12", "the red widget", "X", "0603", "Passive", 0, False, 0.0, 10050.0), ("B9|Y", "B-9", "B9", "a ring", "Y", "0402", "Active", 1, False, None, 500.0)],
        "xid string, mpn string, mpn_norm string, description string, manufacturer string, package string, category string, stock long, is_basic boolean, price_usd double, resistance double",
    )
    values = parts.select("xid", F.lit("resistance").alias("parameter"), F.col("resistance").alias("value"))
    texts = {1: "a-1", 2: "the widget", 3: "ring 0402", 4: "10k widget", 5: "12k widget", 6: " ; ", 7: "0402", 8: "A12 0402"}
    queries = spark.createDataFrame(list(texts.items()), "query_id int, raw_query string")
    rows = search.lexical(queries, parts, values)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["xid"][0:3].rstrip("|"), r["tier"]))
    assert got == {
        1: [("A1", "exact"), ("A12", "trig")], 2: [("A1", "fts"), ("A12", "fts")], 3: [("A1", "fts"), ("B9", "fts")], 4: [("A1", "fts"), ("A12", "fts")],
        5: [("A12", "nearest"), ("A1", "nearest")], 7: [("A1", "exact"), ("B9", "exact")],
    }
    sheets = spark.createDataFrame([("A1|X", "u2"), ("A1|X", "u1")], "xid string, url string")
    assert {r["xid"] for r in search.lexical(queries, parts, values, datasheets=sheets).collect()} == {"A1|X"}
    docs = {r["query_id"]: json.loads(r["json"]) for r in search.result_documents(search.shaped(rows, parts, sheets, ["resistance"]), queries).collect()}
    one = docs[1]["results"][0]
    assert tuple(one) == search.RESULT and one["datasheets"] == ["u1", "u2"] and one["params"] == {"resistance": 10000.0} and one["similarity"] is None and one["match_type"] == "exact"
    assert docs[6] == {"version": 1, "query": " ; ", "nearest_match": False, "count": 0, "results": []} and docs[5]["nearest_match"]
