"""Queries that ask for one thing share its answer: against brute force, and no table grows with queries times parts."""

import random

import pytest

from quarry import staging
from quarry.operators import search

WORDS = "ring bolt valve rings the copper plates".split()


def largest(spark, made):
    return max(spark.read.parquet(p).count() for p in made)


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(9)
    rows = [(f"x{i}", " ".join(rng.choices(WORDS, k=rng.randint(0, 3)))) for i in range(400)] + [("x1", "ring bolt"), ("x2", None), (None, "ring")]
    asked = [(i, " ".join(rng.choices(WORDS + ["none"], k=1 + i % 2))) for i in range(300)] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "xid string, description string"), spark.createDataFrame(asked, "query_id long, raw_query string")


def test_full_text_counts(spark, catalogue):
    parts, asked = catalogue
    want = {}
    for r in search.full_text(asked, parts).collect():
        want.setdefault(r["query_id"], []).append(r["xid"])
    with staging.recorded() as made:
        got = {r["query_id"]: (r["hits"], r["first_xid"]) for r in search.full_text_counts(asked, parts).collect()}
    assert got == {q: (len(x), min(i for i in x if i is not None)) for q, x in want.items()}
    assert largest(spark, made) <= 300


@pytest.fixture(scope="module")
def figures(spark):
    rng = random.Random(10)
    values = [(f"x{i}", p, rng.choice(v)) for i in range(600) for p, v in (("resistance", [10.0, 10.05, 20.0]), ("capacitance", [1.0, 1.04, 3.0])) if rng.random() < 0.9]
    values += [("x3", "resistance", 10.0), ("x3", "resistance", 10.05), ("x4", "resistance", None), ("x5", "capacitance", float("nan"))]
    targets = [(i, "resistance", rng.choice([10.0, 20.5, 30.0])) for i in range(200)] + [(i, "capacitance", rng.choice([1.0, 3.5])) for i in range(0, 200, 2)]
    return spark.createDataFrame(values, "xid string, parameter string, value double"), spark.createDataFrame(targets, "query_id long, parameter string, target double"), values, targets


def test_equal_targets_are_met_once(spark, figures):
    values, targets, v, t = figures
    fits = lambda p, want, x: x is not None and want * (1 - search.BRACKETS[p]) <= x <= want * (1 + search.BRACKETS[p])
    own, wanted = {}, {}
    for x, p, n in v:
        own.setdefault(x, []).append((p, n))
    for q, p, n in t:
        wanted.setdefault(q, []).append((p, n))
    want = sorted((q, x) for q, w in wanted.items() for x, o in own.items() if all(any(p == r and fits(p, n, y) for r, y in o) for p, n in w))
    with staging.recorded() as made:
        got = sorted(map(tuple, search.parametric(targets, values).collect()))
    assert got == want and len(got) > 3000
    assert largest(spark, made) <= 600


def test_nearest_of_groups(spark, figures):
    values, targets, v, _ = figures
    ids = sorted({x for x, _, _ in v} | {"bare"})
    rows = [(i % 3, x) for i, x in enumerate(ids)]
    members = spark.createDataFrame(rows, "group long, xid string")
    queries = targets.selectExpr("query_id", "query_id % 3 AS group").distinct()
    values = values.where("NOT isnan(value)")
    relaxed = queries.join(members, "group").select("query_id", "xid")
    hard = search.parametric(targets, values).join(relaxed, ["query_id", "xid"], "left_semi")
    plain = search.nearest(targets, relaxed, hard, values, 4)
    with staging.recorded() as made:
        got = search.nearest_of_groups(targets, queries, members, values, 4).collect()
    row = lambda r: (r["query_id"], r["rank"], r["xid"], round(r["distance"], 9))
    assert sorted(map(row, got)) == sorted(map(row, plain.collect())) and got
    assert largest(spark, made) <= 3000  # 200 queries with 200 members each are 40,000


def test_like_texts_are_answered_once(spark, catalogue):
    """120 queries that read as three: what parts meet their quantities is written for the three."""
    rows = [(f"x{i}", f"N{i}", "ring bolt", None, 1, False, 1.0) for i in range(300)]
    parts = spark.createDataFrame(rows, "xid string, mpn_norm string, description string, package string, stock long, is_basic boolean, price_usd double")
    values = spark.createDataFrame([(f"x{i}", "resistance", 10.0 if i % 2 else 500.0) for i in range(300)], "xid string, parameter string, value double")
    asked = spark.createDataFrame([(i, ["10ohm ring", "10ohm  bolts", "77ohm ring"][i % 3]) for i in range(120)], "query_id long, raw_query string")
    with staging.recorded() as made:
        got = search.lexical(asked, parts, values, limit=2).collect()
    assert largest(spark, made) <= 300
    first = sorted(f"N{i}" for i in range(300))
    direct, near = [n for n in first if int(n[1:]) % 2][:2], sorted(first[:2], key=lambda n: (abs((10.0 if int(n[1:]) % 2 else 500.0) - 77), n))
    for i in range(120):
        have = [r["mpn_norm"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert have == (near if i % 3 == 2 else direct)
