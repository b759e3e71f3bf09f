"""Embeddings of parts: an injected encoder, writes, and the reconcile job."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .refresh import embed_action

BATCH = 256


def hashing_encoder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model: hashed words, of length 1. For tests."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def encode(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """(``key``, embedding, embed_text_hash) of the rows whose text is not blank.

    ``encoder`` is called in the tasks with up to ``BATCH`` texts, in order; a vector of
    another width, or a wrong number of them, is an error.
    """
    rows = rows.where(F.trim(text) != "").select(key, F.col(text).alias("text"), F.sha2(text, 256).alias("embed_text_hash"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                vectors = encoder(part["text"].to_pylist())
                if len(vectors) != part.num_rows or any(len(v) != dim for v in vectors):
                    raise ValueError(f"the encoder must give {part.num_rows} vectors of width {dim}")
                yield pa.RecordBatch.from_arrays([part[key], pa.array(vectors, pa.list_(pa.float32())), part["embed_text_hash"]], [key, "embedding", "embed_text_hash"])

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>, embed_text_hash string"
    return rows.mapInArrow(run, schema)


def write(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``parts`` with the vectors and hashes of ``vectors`` (xid, embedding, embed_text_hash) where it has
    the part; vectors of unknown parts make no rows, parts without one keep what they have. Of
    several vectors of a part the one with the greatest hash counts."""
    one = vectors.where("xid IS NOT NULL AND embedding IS NOT NULL").groupBy("xid").agg(F.max(F.struct("embed_text_hash", "embedding")).alias("v"))
    new = {c: F.coalesce(F.col("v")[c], F.col(c)).alias(c) for c in ("embedding", "embed_text_hash")}
    return parts.join(one, "xid", "left").select(*[new.get(c, F.col(c)) for c in parts.columns])


def reconcile(parts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], dim: int) -> tuple[DataFrame, DataFrame]:
    """Parts (xid, description, category, package, tags, embedding, embed_text_hash, ...) after a run,
    and its summary (embedded, backfilled, skipped).

    Only parts without a vector, or whose text has changed, are encoded; a vector without a
    hash gets the hash of its text; parts without text are left alone.
    """
    text = exprs.embed_text(F.col("description"), F.col("category"), F.col("package"), F.col("tags"))
    rows = parts.withColumn("__text", text)
    rows = rows.withColumn("__action", embed_action(F.col("__text"), F.col("embed_text_hash"), F.col("embedding").isNotNull()))
    made = encode(rows.where(F.col("__action").isin("embed", "reembed")), "xid", "__text", encoder, dim)
    stamped = rows.withColumn("embed_text_hash", F.when(F.col("__action") == "backfill", F.sha2("__text", 256)).otherwise(F.col("embed_text_hash")))
    of = lambda *k: F.count_if(F.col("__action").isin(*k))
    summary = rows.agg(of("embed", "reembed").alias("embedded"), of("backfill").alias("backfilled"), of("skip", "none").alias("skipped"))
    return write(stamped.select(*parts.columns), made), summary


def any_embedded(parts: DataFrame) -> bool:
    """Whether any part has a vector; reads no more rows than it takes to find one."""
    return not parts.where("embedding IS NOT NULL").limit(1).isEmpty()
