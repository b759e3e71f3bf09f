"""SimHash near-duplicates over pivot distance tables.

Each distinct fingerprint stores its Hamming distances to many reference fingerprints.
The distance of two fingerprints is at least the largest difference between their
entries, so a pair whose tables differ by more than the limit anywhere is discarded
without comparing the fingerprints; survivors are verified.

The first references are zero and one for each pair of neighbouring bits, which has just
these two set: the distances to zero and to such a reference tell how many bits of the
pair are set, 0, 1 or 2. Fingerprints within 2 bits differ in at most two of these 32
numbers. Dealt into five groups, at least three groups agree, so each fingerprint falls
into ten buckets, by three of its groups, no near pair is missed, and the pairs of a
bucket are held against each other's whole tables, whose other references are spread at
random. A bucket of more than ``BUCKET`` fingerprints, such as
a large group of near copies makes, is not paired up. Its members are linked through the
words one bit away instead: two fingerprints are within 2 bits exactly if they share a
word that is at most one bit from either, and every member is linked to the least one
that shares the word. That is 65 rows a fingerprint, however large the group.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED, SHINGLE, BITS = 42, 3, 2
#: References spread at random, beside those of the pairs of bits.
SPREAD = 24
#: Numbers of pairs of bits in each group.
GROUPS = (7, 7, 6, 6, 6)
BUCKET = 64
#: Shares that the rows of equal fingerprints are dealt into.
SHARES = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> list[int]:
    """Zero, the references of the 32 pairs of bits, and those spread at random."""
    spread = (int.from_bytes(hashlib.sha256(b"pivot %d" % i).digest()[:8], "little") for i in range(SPREAD))
    return [0, *(_signed(3 << 2 * i) for i in range(32)), *map(_signed, spread)]


def distances(fp: Column) -> Column:
    """A fingerprint's pivot table."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])


def bucket_keys(table: Column) -> Column:
    """array<struct(t, bits)> of a pivot table: the numbers of three groups of pairs of bits each."""
    pairs = F.transform(F.slice(table, 2, 32), lambda d: F.shiftright(table[0] + 2 - d, 1))
    starts = [1 + sum(GROUPS[:g]) for g in range(len(GROUPS))]
    codes = F.array(*[F.aggregate(F.slice(pairs, at, n), F.lit(0).cast("long"), lambda acc, x: acc * 3 + x) for at, n in zip(starts, GROUPS, strict=True)])

    def keys(c: Column) -> Column:
        width = 3 ** max(GROUPS)
        return F.array(*[F.struct(F.lit(t).alias("t"), ((c[i] * width + c[j]) * width + c[k]).alias("bits")) for t, (i, j, k) in enumerate(combinations(range(len(GROUPS)), 3))])

    return F.element_at(F.transform(F.array(codes), keys), 1)


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of unsigned hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 if it has no words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(line[a:b], SEED) for a, b in spans], np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; null and blank texts have fingerprint 0."""

    def run(batches):
        for b in common.sliced(batches, "text"):
            fps = np.array([simhash(t or "", size) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def candidates(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, bits, fp, n): the buckets of distinct ``fp`` that hold more than one, and the pairs (a, b,
    d) of buckets of up to ``BUCKET``, with ``d``, by how much their pivot tables differ at most."""
    rows = fps.select("fp", F.explode(bucket_keys(distances(F.col("fp")))).alias("k")).select("fp", "k.t", "k.bits")
    counts = rows.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = common.stage_table(rows.join(counts, ["t", "bits"]), "buckets")
    cold = rows.where(F.col("n") <= BUCKET).select("t", "bits", "fp", distances(F.col("fp")).alias("d"))
    a, b = cold.alias("a"), cold.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp"))
    apart = F.array_max(F.zip_with(F.col("a.d"), F.col("b.d"), lambda x, y: F.abs(x - y)))
    return rows, a.join(b, same).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), apart.alias("d"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect just what lies within 2 bits; ``fps`` holds distinct ``fp``."""
    rows, pairs = candidates(fps)
    near = pairs.where((F.col("d") <= BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b").distinct()
    hot = rows.where(F.col("n") > BUCKET).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    around = hot.select("fp", F.explode(around).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
    through = around.join(least, "word").where("fp != b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(through)


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reached over links, for every row.

    Equal fingerprints are linked, so only distinct ones are compared. Rows without an
    id take the component of what they link to, null if that has no id either. Columns
    other than doc_id and text are left out; an empty table gives an empty table.
    """
    found = common.stage_table(fingerprints(docs, size), "fingerprints")
    distinct = common.stage_table(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    joined = components(links(distinct.select("fp")))
    labelled = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # a group of equal fingerprints may be large: its rows are dealt by share as well
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share")
    labelled = labelled.join(least, "label").select("fp", "component_id", shares)
    found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    return found.join(labelled, ["fp", "share"]).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classes`` of every row of ``documents``, fingerprints as 16 hexadecimal digits; nulls, empty
    texts, repeated rows and empty tables as it says there."""
    out = classes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are the first of their class by id.

    Rows with equal ids are one document; rows without an id stay. Nulls, empty texts and
    empty tables are as ``classes`` says.
    """
    later = common.stage_table(classes(docs).where("component_id < doc_id").select("doc_id").distinct(), "later")
    return docs.join(common.small(later), "doc_id", "left_anti").select(*docs.columns)
