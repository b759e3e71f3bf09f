"""Paths between pairs and distances against brute force."""

import random
from collections import deque

from quarry import staging
from quarry.operators import graph


def bfs(edges, root):
    out, queue = {root: 0}, deque([root])
    while queue:
        n = queue.popleft()
        for a, b in edges:
            if a == n and b not in out:
                out[b] = out[n] + 1
                queue.append(b)
    return out


def test_between_is_shortest(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(70)] + [(0, b) for b in range(1, 30)] + [(100 + i, 101 + i) for i in range(9)] + [(3, None), (None, 4)]
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 2)] + [(100, 109), (100, 105), (109, 100), (5, 5), (5, 5), (777, 777), (1, None), (None, 1), (100, 888)]
    real = {e for e in edges if None not in e}
    for hops in (0, 1, 4, 9):
        got = graph.between(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "src long, dst long"), hops).collect()
        want = {(a, b): d for a, b in pairs if a is not None for d in [bfs(real, a).get(b)] if d is not None and d <= hops}
        assert {(r["src"], r["dst"]): r["hops"] for r in got} == want and len(got) == len(want)
        for r in got:
            p = r["path"]
            assert p[0] == r["src"] and p[-1] == r["dst"] and len(p) == r["hops"] + 1 and all(e in real for e in zip(p, p[1:], strict=False))


def test_distances(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = graph.distances(e, spark.createDataFrame([(0,), (0,), (None,)], "node long"), 5)
    assert {r["node"]: r["hops"] for r in got.collect()} == {n: d for n, d in bfs(edges, 0).items() if d <= 5}
    assert graph.distances(e, spark.createDataFrame([], "node long"), 5).count() == 0
    assert graph.between(e, spark.createDataFrame([], "src long, dst long"), 3).count() == 0


def test_largest_level_is_not_made(spark):
    """Two sources, 40 nodes each behind them and 4,000 ends behind those, of which 200 are asked for."""
    edges = [(f"R{i}", f"M{i}-{k}") for i in (0, 1) for k in range(40)] + [(f"M{i}-{k}", f"E{k}-{j}") for i in (0, 1) for k in range(40) for j in range(100)]
    pairs = [(f"R{j % 2}", f"E{j % 40}-{j}") for j in range(100)] + [("R0", f"E1-{j}") for j in range(100)] + [("R1", "none")]
    with staging.recorded() as made:
        got = graph.between(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), 3).collect()
    assert {(r["src"], r["dst"]): r["hops"] for r in got} == dict.fromkeys(pairs[:-1], 2)
    levels = [p for p in made if "-forth_" in p or "-back_" in p]
    assert levels and max(spark.read.parquet(p).count() for p in levels) <= 200
