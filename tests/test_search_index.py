"""The positional gram index and the range join, on planted hard cases."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import search

PARTS = "xid string, mpn_norm string, package string, stock long, is_basic boolean"


@pytest.fixture(scope="module")
def numbers():
    rng = random.Random(3)
    rows = [(f"x{i}", "".join(rng.choice("AB1") for _ in range(rng.randint(0, 9))), rng.choice(["0402", "0603", None]), rng.choice([None, 0, 5]), rng.random() < 0.3) for i in range(400)]
    return [*rows, ("null", None, None, 1, False), ("long", "ABAB1" * 60, "0402", 1, True)]


def test_containing_is_brute_force(spark, numbers):
    parts = spark.createDataFrame(numbers, PARTS)
    needles = ["A", "1B", "ABA", "AAAA", "BAB1", "B1B1B", "ABAB1ABAB1", "ZZZ", "AZ", "", None, "ABAB1" * 30]
    found = search.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), parts).collect()
    assert sorted((r["needle"], r["xid"]) for r in found) == sorted((n, x) for n in needles if n for x, number, *_ in numbers if n in (number or ""))
    q = spark.createDataFrame([(1, "a-b a"), (2, "aba"), (3, None), (4, "#")], "query_id long, raw_query string")
    have = sorted((r["query_id"], r["xid"]) for r in search.substring(q, parts).collect())
    assert have == sorted((i, x) for i in (1, 2) for x, number, *_ in numbers if "ABA" in (number or ""))
    assert search.containing(spark.createDataFrame([], "needle string"), parts).count() == search.containing(spark.createDataFrame([("A",)], "needle string"), parts.limit(0)).count() == 0


def test_common_needles_keep_their_best(spark, numbers):
    """A letter that most numbers have makes no more rows than were asked for."""
    parts = spark.createDataFrame(numbers, PARTS)
    asked = [("A", None), ("A", "0402"), ("AB", "0603"), ("ABA", None)]
    found = search.containing(spark.createDataFrame(asked, "needle string, package string"), parts, 5, package=True).collect()
    rank = lambda r: (not (r[3] or 0) > 0, not r[4], r[1], r[0])
    want = []
    for n, package in asked:
        rows = sorted((r for r in numbers if n in (r[1] or "") and package in (None, r[2])), key=rank)[:5]
        want += [(n, package or "", r[0]) for r in rows]
    assert sorted((r["needle"], r["package"], r["xid"]) for r in found) == sorted(want)


def brute(targets, values):
    width = lambda p: search.BRACKETS.get(p, 0.0)
    queries = {}
    for q, p, t in targets:
        queries.setdefault(q, []).append((p, t))
    held = {}
    for x, p, v in values:
        held.setdefault(x, []).append((p, v))
    fits = lambda t, v, f: v is not None and v == v and min(t * (1 - f), t * (1 + f)) <= v <= max(t * (1 - f), t * (1 + f))
    return sorted((q, x) for q, wanted in queries.items() for x, own in held.items() if all(any(p == r and fits(t, v, width(p)) for r, v in own) for p, t in wanted))


@pytest.fixture(scope="module")
def crowded():
    """Half of the values are equal; others are negative, zero, tiny, huge, null or no number."""
    rng = random.Random(5)
    values = [(f"x{i}", "resistance", 10_000.0 if i % 2 else rng.choice([rng.uniform(1, 1e6), -rng.uniform(1, 100), 0.0, 1e-12, 1e12])) for i in range(1500)]
    values += [(f"x{i}", "capacitance", rng.choice([1e-9, 1e-6, -1e-6])) for i in range(0, 1500, 3)] + [("x1", "tag", 3.0), ("x2", "resistance", None), ("x3", "capacitance", float("nan")), ("y", "resistance", float("inf"))]
    targets = [(1, "resistance", 10_050.0), (2, "resistance", -50.0), (3, "resistance", 0.0), (4, "resistance", 10_000.0), (4, "capacitance", 1e-9), (5, "tag", 3.0), (6, "nothing", 1.0), (7, "resistance", 1e-12), (8, "capacitance", -1.02e-6), (9, "resistance", float("inf"))]
    targets += [(100 + i, "resistance", values[2 * i][2]) for i in range(60)]
    return targets, values


def test_range_join_is_brute_force(spark, crowded):
    targets, values = crowded
    found = search.parametric(spark.createDataFrame(targets, "query_id long, parameter string, target double"), spark.createDataFrame(values, "xid string, parameter string, value double"))
    assert sorted(map(tuple, found.collect())) == brute(targets, [v for v in values if v[2] is not None])


def test_crowded_buckets_are_dealt_evenly(spark, crowded):
    """Joined by a shuffle, half of all values being equal, no task has over twice the mean."""
    targets, values = crowded
    values = spark.createDataFrame([v for v in values if v[2] is not None] * 4, "xid string, parameter string, value double").where("NOT isnan(value)").withColumn("xid", F.concat("xid", F.lit("-"), F.monotonically_increasing_id()))
    cuts = search._cuts(values)
    bucket = lambda c: F.size(F.filter("cuts", lambda x: x <= c))
    v = values.join(cuts, "parameter").select("xid", "parameter", "value", bucket(F.col("value")).alias("bucket")).cache()
    q = spark.createDataFrame([t for t in targets if t[1] == "resistance" and t[2] < 1e13], "query_id long, parameter string, target double").join(cuts, "parameter")
    brackets = q.select("query_id", "parameter", F.col("target").alias("low"), F.col("target").alias("high"), bucket(F.col("target")).alias("bucket")).cache()
    n = brackets.count()
    plain, dealt = search.bucket_join(brackets, n, v), search.bucket_join(brackets, n, v, few=0)
    assert sorted(map(str, plain.select("query_id", "xid").collect())) == sorted(map(str, dealt.select("query_id", "xid").collect()))
    sizes = v.groupBy("parameter", "bucket").count().collect()
    share = -(-v.count() // (16 * 4))
    parts = {(r["parameter"], r["bucket"]): -(-r["count"] // share) for r in sizes}
    assert max(parts.values()) > 10  # the crowded bucket is many parts
    rows = v.withColumn("parts", F.create_map(*[F.lit(x) for k, p in parts.items() for x in (f"{k[0]}/{k[1]}", p)])[F.concat("parameter", F.lit("/"), "bucket")])
    per_task = rows.withColumn("part", F.pmod(F.xxhash64("xid"), "parts").cast("int")).repartition(4, "parameter", "bucket", "part").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= 2 * v.count() / 4
