"""Short texts within long ones: the estimate against brute-force containment."""

import random

from quarry.llm import fingerprints


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def share(t, u):
    a, b = sorted((shingles(t), shingles(u)), key=len)
    return len(a & b) / len(a) if a else float(not b)


def test_short_within_long(spark):
    rng, rows = random.Random(9), []
    for k in range(60):  # short, the long text that holds it, then a long text that does not
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [" ".join(words[50 : 50 + rng.randrange(5, 15)]), " ".join(words), " ".join(f"x{rng.randrange(10**6)}" for _ in range(120))]
        rows += [" ".join(words), " ".join(words[20:30])]  # long, then a short part of it
    got = {r["doc_id"]: r for r in fingerprints.compare(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    bare = 0
    for i, t in enumerate(rows):
        u, truth = rows[(i + 1) % len(rows)], share(t, rows[(i + 1) % len(rows)])
        if truth in (0.0, 1.0):
            assert got[i]["near_next"] == truth, i
        bare += truth == 1.0 and min(got[i]["sketch"][0], got[(i + 1) % len(rows)]["sketch"][0]) >= 0 and len(t.split()) != len(u.split())
        if share(t, got[i]["edited"]) in (0.0, 1.0):
            assert got[i]["near_edited"] == share(t, got[i]["edited"]), i
    assert bare >= 120


def test_texts_are_shuffled_once(spark, tmp_path):
    """All three reads of the texts share one exchange."""
    spark.createDataFrame([(i, f"text {i} " * 20) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans reuse exchanges only as they run
    try:
        plan = fingerprints.op3_fingerprint(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans = [x for x in plan.splitlines() if "FileScan" in x and "[doc_id#" in x and ",text#" in x]
    assert len(scans) == 1 and plan.count("ReusedExchange") >= 2, plan
