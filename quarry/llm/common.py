"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..staging import discard, recorded, scratch_path, stage_table  # noqa: F401  (used as common.stage_table)

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task hands to Python objects at once.
SLICE = 1 << 20
#: Rows of a few numbers that may be broadcast.
SMALL = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(staged: DataFrame, rows: int = SMALL) -> DataFrame:
    """``staged``, a written table of keys, to be sent to every task if it has at most ``rows``; a
    larger one is joined by a shuffle."""
    return F.broadcast(staged) if staged.count() <= rows else staged


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_array(c: Column) -> Column:
    """Words of a text; empty for a null, empty or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def id_remainder(c: Column, mod: int) -> Column:
    """crc32 of the decimal id, modulo ``mod``; a null id counts as an empty string."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def with_fields(schema: StructType, **types: str) -> StructType:
    """``schema`` with further fields, given as name=DDL type."""
    return StructType([*schema.fields, *(StructField(k, DataType.fromDDL(v)) for k, v in types.items())])


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` int labels, of which hash partitioning into ``n`` puts one into each partition."""
    found: dict[int, int] = {}
    size = 64 * n
    while len(found) < n:  # n rows reach the driver
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
        found = {r["at"]: r["label"] for r in spark.range(size, numPartitions=1).select(at, F.col("id").cast("int").alias("label")).groupBy("at").agg(F.min("label").alias("label")).collect()}
        size *= 2
    return [found[i] for i in range(n)]


def pack(batch: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as one compressed Arrow stream: what is to be shuffled takes less disk."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as w:
        w.write(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def release(spark: SparkSession) -> None:
    """Let what finished writes have shuffled go from the executors' disks now: Spark removes it once the
    driver's JVM has collected what stood for it, which may else be long after."""
    spark._jvm.System.gc()


def trim() -> None:
    """Give memory that a task has freed back to the system, as its Python worker lives on."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def sliced(batches, column: str, size: int = SLICE):
    """Batches cut where about ``size`` bytes of ``column`` (text) are reached, so that what Python
    holds at once is bounded, but for a single longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)
    trim()
