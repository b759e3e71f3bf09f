"""The SQLite source: tests reach the file, partitions follow the rows that pass."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.sources import sqlite


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = f"{tmp_path_factory.mktemp('db')}/c.db"
    db = sqlite3.connect(out)
    db.execute("CREATE TABLE components (lcsc INTEGER, mfr TEXT COLLATE NOCASE, weight REAL, bare, data BLOB)")
    db.executemany("INSERT INTO components VALUES (?, ?, ?, ?, ?)", [(i, ["Acme", "acme", None][i % 3], None if i % 7 == 0 else i / 4, str(i), b"x") for i in range(3000)])
    db.execute("DELETE FROM components WHERE lcsc BETWEEN 200 AND 2600")  # a hole
    db.commit()
    db.close()
    return out


KINDS = {"lcsc": "bigint", "mfr": "string", "weight": "double", "data": "binary"}


def reader(path, *tests, rows=100):
    return sqlite.SqliteReader(path, "components", rows, ["lcsc"], KINDS, tests)


def test_partitions_have_equal_rows(path):
    r = reader(path)
    sizes = [len(list(r.read(p))) for p in r.partitions()]
    assert sum(sizes) == 599 and all(s == 100 for s in sizes[:-1]) and len(sizes) == 6
    assert len(reader(path, rows=1).partitions()) == 599


def test_tests_are_pushed(path):
    asked = [("lcsc", ">", 2990), ("mfr", "=", "Acme"), ("lcsc", "in", [2991, 2994, 2997, 5]), ("weight", "not null"), ("bare", "=", "7"), ("weight", "=", float("nan")), ("mfr", ">", "A"), ("data", "=", "x"), ("lcsc", "=", True)]
    r = reader(path, *asked)
    where, values = r._where()
    assert where == ' WHERE "lcsc" > ? AND "mfr" = ? AND "lcsc" IN (?, ?, ?, ?) AND "weight" IS NOT NULL' and values == [2990, "Acme", 2991, 2994, 2997, 5]
    parts = r.partitions()
    assert len(parts) == 1 and sorted(x for (x,) in r.read(parts[0])) == [2991, 2994, 2997]
    assert reader(path, ("lcsc", ">", 10_000)).partitions() == []


TESTS = [(("lcsc", ">", 2800),), (("lcsc", "=", 5),), (("lcsc", "in", [1, 2, 2700]),), (("mfr", "=", "Acme"),), (("mfr", "in", ["acme", "x"]),), (("mfr", "null"),), (("weight", "<=", 30.5), ("mfr", "not null")), (("bare", "=", "7"),), (("mfr", ">", "Acme"),), (("lcsc", "<", -1),), (("lcsc", ">=", 0), ("weight", "null"))]


@pytest.mark.parametrize("tests", TESTS)
def test_results_are_those_without_push_down(spark, path, tests):
    every = sqlite.scan(spark, path, "components", rows=100)
    want = spark.createDataFrame([tuple(r) for r in every.collect()], every.schema)
    for column, sign, *value in tests:
        c = F.col(column)
        want = want.where(c.isNull() if sign == "null" else c.isNotNull() if sign == "not null" else c.isin(value[0]) if sign == "in" else sqlite.SIGNS[sign](c, value[0]))
    have = sqlite.scan(spark, path, "components", *tests, rows=100)
    assert sorted(map(str, have.collect())) == sorted(map(str, want.collect()))
    assert have.where("lcsc % 2 = 0").count() == want.where("lcsc % 2 = 0").count() and have.count() == want.count() and every.count() == 599


def test_pushed_test_cuts_partitions(spark, path):
    size = lambda *tests: sqlite.scan(spark, path, "components", *tests, rows=100).rdd.getNumPartitions()
    assert size(("lcsc", ">=", 2990)) == 1 and size(("lcsc", ">=", 0)) == size() == 6


@pytest.mark.parametrize("bad", [("lcsc", "like", "x"), ("lcsc", "="), ("lcsc", "null", 1)])
def test_unknown_tests_are_errors(spark, path, bad):
    with pytest.raises(ValueError, match="no test"):
        sqlite.scan(spark, path, "components", bad)
