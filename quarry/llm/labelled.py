"""Labelled training rows, all of them or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def training_rows(docs: DataFrame, labels: DataFrame, target: str, training: Column, most: int | None = None) -> DataFrame:
    """(doc_id, text, label) of all labelled rows; with ``most``, of about so many of each class, at most.

    Sampled rows are taken by a hash of their id, at a rate that the counts of the small
    labels table give; a class of no more than ``most`` rows is taken whole. Rows with a null
    id or label are left out, and an id labelled twice counts once, with its larger
    label. Ids that are few are sent to the executors, more are joined by a shuffle.
    """
    own = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & training)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    if most is None:
        return docs.select("doc_id", "text").join(common.small(common.stage_table(own, "labels")), "doc_id")
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    rate = F.when(F.col("label") == 1, min(1.0, most / max(1, counts.get(1, 0)))).otherwise(min(1.0, most / max(1, counts.get(0, 0))))
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
