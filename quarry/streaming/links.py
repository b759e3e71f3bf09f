"""Failure counters of links, carried from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.refresh import fail_counts

CHECKS = "url_id long, seq long, alive boolean"
COUNTS = "url_id long, seq long, fail_count long"


def carried(old: DataFrame, checks: DataFrame) -> DataFrame:
    """Counters (url_id, seq, fail_count) after ``checks`` (url_id, seq, alive).

    A good check sets a link's counter to zero, a failed one adds to it. ``seq`` is the
    newest check that a link has seen; checks that are not newer were counted before, or
    come too late, and are left out, as are those without a link, seq or verdict. Links
    without new checks keep their counter. One row a link is all that is carried, and a
    link with very many checks is pre-aggregated like any other.
    """
    seen = old.select("url_id", F.col("seq").alias("__seen"))
    new = checks.select("url_id", "seq", "alive").dropna().distinct().join(seen, "url_id", "left")
    new = new.where("__seen IS NULL OR seq > __seen").drop("__seen")
    newest = new.groupBy("url_id").agg(F.max("seq").alias("__newest"), F.bool_or("alive").alias("__good"))
    batch = newest.join(fail_counts(new).withColumnRenamed("fail_count", "__failed"), "url_id")
    before = F.when(F.coalesce("__good", F.lit(False)), 0).otherwise(F.coalesce("fail_count", F.lit(0)))
    count = (before + F.coalesce("__failed", F.lit(0))).cast("long").alias("fail_count")
    return old.join(batch, "url_id", "full").select("url_id", F.coalesce("__newest", "seq").alias("seq"), count)


def count_failures(spark: SparkSession, source: str, state: str) -> None:
    """Carry the counters under ``state`` over the JSON files of ``source`` that are new.

    Snapshots are named and made as in ``ingest``: a replayed batch overwrites itself,
    and a run with no new files adds nothing.
    """

    def carry(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        old = s.read.schema(COUNTS).parquet(f"{state}/snapshot-{batch_id - 1}") if batch_id else s.createDataFrame([], COUNTS)
        carried(old, batch).write.mode("overwrite").parquet(f"{state}/snapshot-{batch_id}")

    stream = spark.readStream.schema(CHECKS).json(source).writeStream.foreachBatch(carry)
    stream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
