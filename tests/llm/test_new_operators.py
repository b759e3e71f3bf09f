"""The prefix trie, the k-means tree and whitening against brute force."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import ann_tree, prefix_trie, whitening

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, level string"
VECTORS = "vec_id long, embedding array<float>, label string, key string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, m in members.items():
        under = [v for v in members if v[: len(node)] == node]
        leaf = lambda v: not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        saved = sum((len(members[v]) - 1) * (len(v[-1][1]) if v else 0) for v in under)
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), sum(len(v) == len(node) + 1 for v in under), sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_is_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 40), *range(100, 112), 205, 207, 209, 301]:  # 200 and 300 are absent
        for t in range(int(rng.integers(1, 23))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "abc"[: int(rng.integers(1, 3))], "x", "y"))
    rows += [(0, None, None, None, "x", "y"), (0, None, "user", "first", "x", "y"), (7, 1, None, "é" * 5, "x", "y"), (7, 1, "user", None, "x", "y"), (7, 1, "user", None, "x", "y"), (None, 1, "user", "nobody", "x", "y")]
    rows += [(50, t, "user", "same", "x", "y") for t in range(30)] + [(51, t, "user", "same", "x", "y") for t in range(30)]
    rows += [(400, 0, "user", "only", "x", "y"), *[(c, 0, "user", "short", "x", "y") for c in range(500, 520)]]
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_turnless_and_empty(spark):
    lone = next(c for c in range(601, 700) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = prefix_trie.trie(spark.createDataFrame([(lone, 0, "user", "gone", "x", "y")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "x", "x", "y")], CONVERSATIONS)).count() == 0


def test_running_sums_cross_ranges(spark):
    rows = spark.createDataFrame([(0 if i % 7 else i, i, 10 * i) for i in range(1, 400)], "k long, o long, x long")
    got = {(r["k"], r["o"]): (r["place"], r["before_x"]) for r in prefix_trie.running(rows, "k", ["o"], ["x"], "t").collect()}
    want, seen = {}, defaultdict(lambda: (0, 0))
    for i in range(1, 400):
        k = 0 if i % 7 else i
        want[k, i] = seen[k]
        seen[k] = (seen[k][0] + 1, seen[k][1] + 10 * i)
    assert got == want


def brute_nearest(rows, k=5):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    most = max((sum(len(v) == n for v in best.values()), n) for n in {len(v) for v in best.values()})[1]
    ids = sorted(i for i in best if len(best[i]) == most)
    m = np.array([best[i] for i in ids], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, m, strict=True):
        if i % 50 == 0:
            order = sorted((round(-float(q @ v), 12), j) for j, v in zip(ids, m, strict=True) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def test_tree_search_finds_all_in_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist(), "x", "y") for i in range(1, 300)]
    copy = rng.standard_normal(6).astype(np.float32).tolist()
    rows += [(i, copy, "x", "y") for i in range(300, 420)]
    bad = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] * 6, [math.inf] * 6, [1.0, 2.0]]
    rows += [(1000 + 50 * i, v, "x", "y") for i, v in enumerate(bad)] + [(None, copy, "x", "y"), rows[49], rows[49], (50, copy, "x", "y")]
    index = ann_tree.Index(spark.createDataFrame(rows, VECTORS))
    got = defaultdict(dict)
    for r in index.search(index.rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id")).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == brute_nearest(rows)


def test_tree_search_reaches_its_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 16))
    m = (centres[rng.integers(0, 60, 6000)] + 0.6 * rng.standard_normal((6000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(m)]
    index = ann_tree.Index(spark.createDataFrame(rows, VECTORS))
    want, hits = brute_nearest(rows), 0
    for r in index.search(index.rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id")).collect():
        hits += r["vec_id"] in want[r["query_id"]]
    assert hits >= 0.9 * 5 * len(want) and index.visits < index.tree.value.leaves and index.recall >= 0.95


@pytest.mark.parametrize("rows", [[], [(None, [1.0, 2.0], "x", "y")], [(50, None, "x", "y")]])
def test_tree_search_without_vectors(spark, rows):
    index = ann_tree.Index(spark.createDataFrame(rows, VECTORS))
    assert index.search(index.rows.selectExpr("vec_id AS query_id")).count() == 0


def test_tree_search_of_one_and_two(spark):
    for n in (1, 2):
        index = ann_tree.Index(spark.createDataFrame([(50 * i, [1.0, float(i)], "x", "y") for i in range(n)], VECTORS))
        got = index.search(index.rows.selectExpr("vec_id AS query_id")).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == ([] if n == 1 else [(0, 1, 50), (50, 1, 0)])


def test_tree_places_and_visits():
    rng = np.random.default_rng(1)
    m = rng.standard_normal((3000, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    tree = ann_tree.Tree.fit(m, 40)
    visits = tree.visits(m[:50], tree.leaves)
    assert all(sorted(v) == list(range(tree.leaves)) for v in visits.tolist()) and set(tree.place(m)) == set(range(tree.leaves))
    assert (visits[:, :3] == tree.place(m[:50])[:, None]).any(axis=1).mean() > 0.6


def brute_white(rows):
    m = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in m])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, b = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in m], ((n * x - s) ** 2).sum(axis=1), y @ b[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) * [1, 3, 0.2] + 2).astype(np.float32).tolist(), "x", "y") for i in range(500)]
    rows += [(None, [9.0, 9.0, 9.0], "x", "y"), rows[3], (600, None, "x", "y"), (601, [1.0, None, 2.0], "x", "y"), (602, [math.nan] * 3, "x", "y"), (603, [1.0, -math.inf, 0.0], "x", "y"), (604, [1.0], "x", "y"), (605, [], "x", "y")]
    vectors = spark.createDataFrame(rows, VECTORS)
    fit = whitening.Whitener.fit(vectors)
    ids, far, white, share = brute_white(rows)
    got = sorted(fit.apply(vectors).collect(), key=lambda r: (str(r["vec_id"]), r["deviation"]))
    want = sorted(zip(ids, far, white, strict=True), key=lambda r: (str(r[0]), r[1]))
    assert [(r["vec_id"], int(r["deviation"])) for r in got] == [(i, f) for i, f, _ in want]
    a, b = np.array([r["whitened"] for r in got]), np.array([w for _, _, w in want])
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-9 and np.allclose(fit.explained, share, rtol=1e-12)
    assert fit.certified.all() and fit.identity_error(vectors) < 1e-9


def test_whitening_of_little(spark):
    for rows, n in (([], 0), ([(1, None, "x", "y")], 0), ([(1, [1.0, 2.0], "x", "y")], 1), ([(1, [1.0, 2.0], "x", "y")] * 3, 3)):
        vectors = spark.createDataFrame(rows, VECTORS)
        fit = whitening.Whitener.fit(vectors)
        got = fit.apply(vectors).collect()
        assert fit.n == n == len(got) and all(r["deviation"] == 0 and r["whitened"] == [None, None] for r in got) and fit.identity_error(vectors) == 0
    flat = [(i, [float(i), 5.0], "x", "y") for i in range(10)]  # one of two dimensions varies
    got = whitening.Whitener.fit(spark.createDataFrame(flat, VECTORS)).apply(spark.createDataFrame(flat, VECTORS)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1] is None for r in got)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e12 + 1e6 * i, -3e11 * i], "x", "y") for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, key string")
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v, *_ in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = sorted(sum((50 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x)
    fit = whitening.Whitener.fit(vectors)
    assert sorted(int(r["deviation"]) for r in fit.apply(vectors).collect()) == want and fit.sums == s


@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_leading_pairs(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = np.sort(np.repeat(rng.random(-(-n // 2)), 2)[:n] * 10.0 ** rng.integers(-3, 4, n))[::-1]
    e[1::7] = e[0:-1:7][: len(e[1::7])]  # equal ones
    e = np.sort(e)[::-1]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 8)
    assert np.allclose(values, e[:8], atol=1e-12 * e[0]) and np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)
    assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-10 * e[0] and whitening.certified(v, values).all()
    assert all(whitening.inertia(v - s * np.eye(n)) == (np.linalg.eigvalsh(v) > s).sum() for s in rng.random(20) * e[0] + 1e-5)


def test_inertia_with_pivots_of_two():
    for a in itertools.product([-1.0, 0.0, 2.0], repeat=6):
        m = np.zeros((3, 3))
        m[np.triu_indices(3)] = a
        m = m + np.triu(m, 1).T
        e = np.linalg.eigvalsh(m)
        if np.abs(e).min() > 1e-9:
            assert whitening.inertia(m) == (e > 0).sum()
