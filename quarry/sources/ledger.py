"""Which files were loaded already, and what a load did."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of every file under ``path``, without reading what is in them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unseen(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differs from what the ledger says."""
    return found.join(ledger, ["path", "size", "modified"], "left_anti")


def write_measured(rows: DataFrame, path: str) -> dict[str, float]:
    """Write ``rows`` to a new folder; rows written, seconds and rows a second, counted on the way."""
    seen, began = Observation(), time.monotonic()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    took = time.monotonic() - began
    return {"parts_loaded": seen.get["n"], "wall_seconds": took, "parts_per_second": seen.get["n"] / max(took, 1e-9)}


def write_observed(rows: DataFrame, path: str, **figures: Column) -> dict:
    """Write ``rows`` to a new folder; how many there were and other aggregates, taken on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in figures.items()]).write.parquet(path)
    return seen.get
