"""Toxicity learns from every labelled document; its regression is the one over all rows."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common, toxicity


def test_every_labelled_document_counts(spark):
    n = 21_000  # more of one class than the sample of former rounds held
    docs = spark.range(n + 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("plain talk "), F.col("id") % 50)).otherwise(F.concat(F.lit("you are a gribbler, you number "), F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= n).cast("int").alias("toxic"))
    with common.recorded() as made:
        model = toxicity.train(docs, labels, F.lit(True))
    (labelled,) = [p for p in made if p.endswith("-labelled")]
    assert spark.read.parquet(labelled).count() == n + 40
    assert any("grib" in p for p, _ in model.patterns)
    assert toxicity.score(docs, labels, F.lit(True)).where(f"predicted = 1 AND doc_id < {n}").count() == 0


def test_fit_is_the_dense_regression(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(1.0, (400, 3)), 1)
    y = (rng.random(400) < 1 / (1 + np.exp(2 - x[:, 0] - 0.5 * x[:, 1] + 0.8 * x[:, 2]))).astype(int)
    rows = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x, strict=True)], "label int, a double, b double, c double").groupBy("label", "a", "b", "c").agg(F.count("*").alias("n"))
    got = toxicity.fit(rows, ["a", "b", "c"])
    a, w, keep = np.hstack([x[:, :2], np.ones((400, 1))]), np.zeros(3), 1e-2 * np.eye(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + keep, a.T @ (y - p) - keep @ w)
    assert got[2] == 0 and np.allclose(got[[0, 1, 3]], w, atol=1e-8)  # the third would be negative
