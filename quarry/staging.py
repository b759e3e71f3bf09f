"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOTS: set[str] = set()
_RECORDERS: list[list[str]] = []


def _warehouse(spark: SparkSession) -> str:
    """The warehouse; an error on a cluster where nobody has set it, as Spark's default lies on the driver's own disk."""
    if not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir, or spark.sql.warehouse.dir, to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder: that of spark.checkpoint.dir, else the warehouse.
    All of an application's paths lie in one folder, which Spark removes when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _warehouse(spark)
    root = f"{base.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{root}/{uuid.uuid4().hex}-{name}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    for made in _RECORDERS:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``stage_table`` with its ``rows`` and other aggregates, taken while it is written."""
    seen = Observation()
    staged = stage_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in figures.items()]), name)
    return staged, seen.get


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables staged inside, in their order."""
    made: list[str] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS[:] = [r for r in _RECORDERS if r is not made]


def discard(spark: SparkSession, paths: list[str], kept: DataFrame | None = None) -> None:
    """Remove staged tables that nothing will read again; not those that ``kept`` still reads."""
    files = kept.inputFiles() if kept is not None and paths else []
    names = [p.rsplit("/", 1)[1] for p in paths]  # unique, however a file's path is written
    used = {n for n in names if any(f"/{n}/" in f for f in files)}
    for path, name in zip(paths, names, strict=True):
        if name not in used:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
