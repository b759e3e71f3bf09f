"""Vector search by tiles, semantic search with filters and both of its orders, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import staging
from quarry.operators import search, vectors


def brute(queries, rows, k, allowed=None):
    out = {}
    for q, v, *on in queries:
        near = []
        for i, w, *of in rows:
            ok = w is not None and len(w) == len(v) and all(x is not None and math.isfinite(x) for x in w) and any(w)
            if i is not None and ok and on == of and (allowed is None or i in allowed):
                near.append((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), i))
        out[q] = [i for _, i in sorted(near)[:k]]
    return {q: x for q, x in out.items() if x}


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    m = centres[rng.integers(0, 12, 900)] + 0.05 * rng.standard_normal((900, 6))  # tight groups, so that tiles are skipped
    out = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(m)]
    out += [(2000 + i, out[5][1], "a") for i in range(40)]  # copies
    return out + [(3000, None, "a"), (3001, [], "a"), (3002, [0.0] * 6, "a"), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a"), (3004, [math.nan] * 6, "a"), (3005, [math.inf] * 6, "b"), (3006, [1.0, 2.0], "a"), (3007, [2.0, 1.0], "a"), (None, out[1][1], "a")]


SCHEMA = "vec_id long, embedding array<double>, kind string"


def test_tiles_are_exact(spark, rows):
    asked = [r for r in rows if r[0] is not None and r[0] % 25 == 0 and r[0] < 2100] + [(3006, [1.0, 2.0], "a")]
    q = spark.createDataFrame(asked, SCHEMA).withColumnRenamed("vec_id", "query_id")
    v = spark.createDataFrame(rows, SCHEMA)
    small = vectors.Tiles(v, tile=32, block=4)
    plain = [(i, w) for i, w, _ in asked]
    assert got(small.nearest(q, 7)) == brute(plain, [(i, w) for i, w, _ in rows], 7)
    allowed = {i for i, *_ in rows if i is not None and i % 3 == 0}
    some = spark.createDataFrame([(i,) for i in allowed] + [(0,), (99_999,)], "vec_id long")
    assert got(small.nearest(q, 7, some)) == brute(plain, [(i, w) for i, w, _ in rows], 7, allowed)
    assert got(small.nearest(q, 7, some.where("vec_id = 99999"))) == {}
    assert got(vectors.Tiles(v, "kind", tile=32, block=4).nearest(q, 7)) == brute(asked, rows, 7)
    assert small.tiles.agg(F.max(F.size("ids"))).first()[0] <= 32
    assert small.tiles.groupBy("block").count().agg(F.max("count")).first()[0] <= 4


def test_blocks_are_as_many_as_rows_ask_for(spark, rows):
    """However many partitions there are, few queries are one block for each length, and floats travel as floats."""
    v = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    q = v.where("vec_id % 3 = 0 AND vec_id < 1000 OR vec_id = 3006").withColumnRenamed("vec_id", "query_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        with staging.recorded() as made:
            near = got(vectors.Tiles(v).nearest(q, 5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held, asked = (spark.read.parquet(next(p for p in made if p.endswith(name))) for name in ("vector_tiles", "query_tiles"))
    assert asked.select("block").distinct().count() == 2
    assert held.select("block").distinct().count() <= 6  # 64 cells and one, 16 tiles a block
    assert held.where("octet_length(unit) <> 4 * dim * size(ids)").count() == 0
    single = lambda w: None if w is None else [x if x is None else float(np.float32(x)) for x in w]
    plain = [(r["query_id"], list(r["embedding"])) for r in q.collect()]
    assert near == brute(plain, [(i, single(w)) for i, w, _ in rows], 5)


def test_far_tiles_are_skipped(monkeypatch, rows):
    import pyarrow as pa

    def tile(m, ids):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        return {"dim": m.shape[1], "ids": list(ids), "unit": m.astype(float).tobytes()}

    rng, held = np.random.default_rng(1), []
    add = vectors.Best.add
    monkeypatch.setattr(vectors.Best, "add", lambda self, live, c, ids: (held.append(c.shape), add(self, live, c, ids))[1])
    near, far = rng.standard_normal((50, 4)) * 0.01 + [1, 0, 0, 0], rng.standard_normal((50, 4)) * 0.01 + [0, 0, 1, 0]
    right = pa.Table.from_pylist([tile(far, range(50, 100)), tile(near, range(50))])
    left = pa.Table.from_pylist([tile(np.array([[1.0, 0, 0, 0]]), [7])])
    out = vectors.met(left, right, 3)
    assert len(held) == 1 and set(out["vec_id"].to_pylist()) <= set(range(50)) and out.num_rows == 3


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0], "a")], SCHEMA)
    ask = lambda df: df.withColumnRenamed("vec_id", "query_id")
    assert got(vectors.Tiles(none).nearest(ask(one), 3)) == got(vectors.Tiles(one).nearest(ask(none), 3)) == {}
    assert got(vectors.Tiles(one).nearest(ask(one), 3)) == {1: [1]}


def test_names_may_be_ids(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert got(vectors.Tiles(v).nearest(v.withColumnRenamed("vec_id", "query_id"), 2)) == {"a": ["a", "b"], "b": ["a", "b"], "c": ["c", "a"]}


PARTS = "xid string, mpn_norm string, package string, manufacturer string, category string, stock long, is_basic boolean, price_usd double"


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(f"x{i:03d}", f"N{i}", ["0402", "0603", None][i % 3], ["Acme Corp", "Best"][i % 2], "resistors", i % 7, i % 5 == 0, None if i % 11 == 0 else float(i % 13)) for i in range(300)]
    return spark.createDataFrame(rows, PARTS)


def test_semantic_filters_and_orders(spark, parts):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((300, 5))
    vectors_ = spark.createDataFrame([(f"x{i:03d}", v.tolist()) for i, v in enumerate(m)], "xid string, embedding array<double>")
    values = spark.createDataFrame([(f"x{i:03d}", "resistance", float(i % 20)) for i in range(300)], "xid string, parameter string, value double")
    asked = [(1, m[3].tolist(), ""), (2, m[4].tolist(), "0603"), (3, m[5].tolist(), "10ohm"), (4, m[6].tolist(), "0402 10ohm"), (5, m[7].tolist(), None), (6, m[8].tolist(), "77Mohm")]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>, raw_query string")
    rows = {r["xid"]: r for r in parts.collect()}

    def want(query, v, text):
        fits = lambda i, r: r["stock"] >= 2 and r["manufacturer"] == "Acme Corp" and ("0603" not in (text or "") or r["package"] == "0603") and ("0402" not in (text or "") or r["package"] == "0402") and ("ohm" not in (text or "") or (i % 20 == 10 and "10ohm" in text))
        near = sorted((-round(float(np.dot(v, m[i]) / np.linalg.norm(v) / np.linalg.norm(m[i])), 9), x) for i, x in enumerate(sorted(rows)) if fits(i, rows[x]))
        return [x for _, x in near[:6]]

    orders = {"relevance": None, "stock": lambda x: (-rows[x]["stock"], rows[x]["mpn_norm"], x), "price": lambda x: (rows[x]["price_usd"] is None, rows[x]["price_usd"] or 0.0, rows[x]["mpn_norm"], x)}
    for sort, key in orders.items():
        found = search.semantic(q, vectors_, parts, values, sort=sort, limit=6, manufacturer="acme", min_stock=2).collect()
        for query, v, text in asked:
            have = [r["xid"] for r in sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])]
            assert have == (sorted(want(query, v, text), key=key) if key else want(query, v, text))


def test_equal_requests_share_their_vectors(spark, parts):
    """Many queries of one quantity: vectors are held once for all of them."""
    rng = np.random.default_rng(3)
    vectors_ = spark.createDataFrame([(f"x{i:03d}", v.tolist()) for i, v in enumerate(rng.standard_normal((300, 4)))], "xid string, embedding array<double>")
    values = spark.createDataFrame([(f"x{i:03d}", "resistance", 10.0) for i in range(300)], "xid string, parameter string, value double")
    q = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), "10ohm") for i in range(50)], "query_id long, embedding array<double>, raw_query string")
    with staging.recorded() as made:
        assert search.semantic(q, vectors_, parts, values, limit=3).count() == 150
    bound = [p for p in made if p.endswith("bound_vectors")]
    assert bound and spark.read.parquet(bound[0]).count() == 300


def test_presence_and_absence(parts):
    """Columns that must or must not be null."""
    have = {r["xid"] for r in search.filtered(parts, has=("price_usd",), lacks=("package",)).collect()}
    assert have == {f"x{i:03d}" for i in range(300) if i % 11 and i % 3 == 2}
