"""Line dedup over sharded cuckoo filters and exact reference counts.

A line's key is the line stripped of ASCII white space, A-Z lower-cased; lines are
known by a 128-bit digest of their key. The state has three tables in the shared folder:

* ``postings``: (key, doc_id), once per row that holds the key, with ``n``, 1 where it is
  added and below 0 where it is taken away;
* ``counts``: (key, refs, owner, last), the exact reference count, smallest and greatest document;
* ``filters``: (shard, filter), a cuckoo filter per shard over the keys with two or more holders.

A change appends to them: its own postings, the new counts of the keys it touches - raised
by insertions, lowered by deletions - and the filters of the shards in which keys became or
stopped being shared, so a deletion restores exactly what an insertion changed. The newest
row of a key or shard counts. A filter that has filled up is made anew, twice as large.

Most lines are unique. Postings are dealt by shard, beside the shard's filter and its shared
keys; only those that the filter lets through are looked up among the exact counts. A
shard with many postings, such as that of a line that very many documents hold, is dealt
in parts of about ``PART`` postings, each with a copy of the filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
#: Shared keys a shard is made for, and postings that are held against a filter at once.
SHARD_KEYS, PART = 20_000, 200_000
#: Share of its room from which a filter is made anew, and tags without a place.
FULL, OVERFLOW = 0.85, 64
#: A null id stands for a document after all others.
NO_ID = (1 << 63) - 1
_SPACES = " \t\n\r\x0b\x0c"
_BASE = "key binary, shard_hash long, doc_id long, tk long"


def line_key(line: str) -> bytes | None:
    """Digest of a line's key, or None if the key is too short to count."""
    key = line.strip(_SPACES)
    return hashlib.blake2b(key.encode("utf-8", "replace").lower(), digest_size=16).digest() if len(key) >= MIN_CHARS else None


class Cuckoo:
    """Cuckoo filter over 16-byte digests: four 16-bit tags a bucket, two buckets a key.

    Tags that find no place go to a small overflow list, so nothing inserted is ever
    reported absent. A key must be deleted only if it was inserted.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, expected: int = 0, table: np.ndarray | None = None, overflow: list[int] | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, expected) / self.SLOTS / 0.8 + 1))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.overflow = overflow or []

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0]
        tags = (words & np.uint64(0xFFFF)).astype(np.uint16)
        tags[tags == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = (words >> np.uint64(16)) & mask
        return tags, first.astype(np.int64), (first ^ self.step(tags)).astype(np.int64)

    def step(self, tags):
        return (np.asarray(tags, np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        tags, a, b = self.places(keys)
        found = (self.table[a] == tags[:, None]).any(1) | (self.table[b] == tags[:, None]).any(1)
        return found | np.isin(tags, np.array(self.overflow, np.uint16))

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        rng = np.random.default_rng(len(keys))
        for tag, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = tag
                    break
            else:
                at = b
                for slot in rng.integers(0, self.SLOTS, self.KICKS).tolist():
                    tag, self.table[at, slot] = int(self.table[at, slot]), tag
                    at ^= int(self.step(tag))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = tag
                        break
                else:
                    self.overflow.append(tag)

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        for tag, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == tag)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                if tag in self.overflow:
                    self.overflow.remove(tag)

    def full(self) -> bool:
        return len(self.overflow) > OVERFLOW or np.count_nonzero(self.table) > FULL * self.table.size

    def dump(self) -> bytes:
        return len(self.overflow).to_bytes(4, "little") + np.array(self.overflow, "<u2").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        n = int.from_bytes(data[:4], "little")
        return cls(table=np.frombuffer(data[4 + 2 * n :], "<u2").reshape(-1, cls.SLOTS).copy(), overflow=np.frombuffer(data[4 : 4 + 2 * n], "<u2").tolist())


def _named(docs: DataFrame) -> tuple:
    """How rows are told apart: by id, and rows without one by their text."""
    known = F.col("doc_id").isNotNull()
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.when(known, 0).otherwise(F.xxhash64("text")).cast("long")


def postings_of(docs: DataFrame) -> DataFrame:
    """(key, shard_hash, doc_id, tk) for each key of each row, once a row."""

    def run(batches):
        for b in common.sliced(batches, "text"):
            keys, at = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                found = {k for k in map(line_key, (text or "").split("\n")) if k}
                keys += found
                at += [i] * len(found)
            hashes, at = [int.from_bytes(k[8:12], "little") for k in keys], pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.int64()), b["id"].take(at), b["tk"].take(at)], ["key", "shard_hash", "doc_id", "tk"])

    id_, tk = _named(docs)
    return docs.select(id_.alias("id"), tk.alias("tk"), "text").mapInArrow(run, _BASE)


def count_refs(postings: DataFrame) -> DataFrame:
    """Exact counts: partial sums are made where the postings lie, so a hot line is no hot task."""
    return postings.groupBy("key", "shard_hash").agg(F.sum("n").alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))


SHARED = "owner < last"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    filt = Cuckoo(2 * len(pdf))  # room to grow
    filt.insert(list(pdf["key"]))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [filt.dump()], "full": [False]})


FILTERS = "shard long, filter binary, full boolean"


class LineIndex:
    """The three tables, as lists of staged DataFrames, oldest first; every change gives a new index
    that shares what did not change with the old one."""

    def __init__(self, postings: list[DataFrame], counts: list[DataFrame], filters: list[DataFrame], shards: int):
        self._postings, self._counts, self._filters, self.shards = postings, counts, filters, shards

    @property
    def postings(self) -> DataFrame:
        if len(self._postings) == 1:
            return self._postings[0]
        return _union(self._postings).groupBy("key", "shard_hash", "doc_id", "tk").agg(F.sum("n").alias("n")).where("n > 0")

    @property
    def counts(self) -> DataFrame:
        if len(self._counts) == 1:
            return self._counts[0]
        dated = _union([c.withColumn("at", F.lit(i)) for i, c in enumerate(self._counts)])
        newest = dated.groupBy("key", "shard_hash").agg(F.max_by(F.struct("refs", "owner", "last"), "at").alias("c"))
        return newest.select("key", "shard_hash", "c.*").where("refs > 0")

    @property
    def filters(self) -> DataFrame:
        if len(self._filters) == 1:
            return self._filters[0]
        dated = _union([f.withColumn("at", F.lit(i)) for i, f in enumerate(self._filters)])
        return dated.groupBy("shard").agg(F.max_by(F.struct("filter", "full"), "at").alias("f")).select("shard", "f.*")

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        postings = common.stage_table(postings_of(docs).withColumn("n", F.lit(1).cast("long")), "postings")
        counts = common.stage_table(count_refs(postings), "counts")
        return cls._sharded([postings], [counts])

    @classmethod
    def _sharded(cls, postings: list[DataFrame], counts: list[DataFrame]) -> LineIndex:
        """An index with filters made anew, in as many shards as its shared keys need."""
        shared = cls(postings, counts, [], 1).counts.where(SHARED)
        shards = max(1, -(-shared.count() // SHARD_KEYS))
        sharded = shared.select("key", F.pmod("shard_hash", F.lit(shards)).alias("shard"))
        filters = common.stage_table(sharded.groupBy("shard").applyInPandas(_fill, FILTERS), "filters")
        return cls(postings, counts, [filters], shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. Those whose id the index holds are left out; rows without an id are all added, and
        together stand for one document, as in ``build``."""
        new = postings_of(docs).join(self.postings.select("doc_id").where(F.col("doc_id") != NO_ID).distinct(), "doc_id", "left_anti")
        new = common.stage_table(new.select("key", "shard_hash", "doc_id", "tk", F.lit(1).cast("long").alias("n")), "new_postings")
        touched = count_refs(new).alias("t")
        old = self.counts.alias("o")
        both = touched.join(old, F.col("t.key") == F.col("o.key"), "left")
        fresh = both.select("t.key", "t.shard_hash", (F.col("t.refs") + F.coalesce("o.refs", F.lit(0))).alias("refs"), F.least("t.owner", "o.owner").alias("owner"), F.greatest("t.last", "o.last").alias("last"))
        return self._changed(new, fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forget the documents in ``doc_ids`` (column doc_id); unknown ids change nothing."""
        ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        held = self.postings
        gone = common.stage_table(held.join(ids, "doc_id", "left_semi").withColumn("n", -F.col("n")), "gone_postings")
        less = gone.groupBy("key", "shard_hash").agg(F.sum("n").alias("less"))
        left = held.join(less.select("key"), "key", "left_semi").join(ids, "doc_id", "left_anti")
        left = left.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        fresh = less.join(self.counts.select("key", "refs"), "key").join(left, "key", "left").select("key", "shard_hash", (F.col("refs") + F.col("less")).alias("refs"), "owner", "last")
        return self._changed(gone, fresh)

    def _changed(self, postings: DataFrame, fresh: DataFrame) -> LineIndex:
        fresh = common.stage_table(fresh, "new_counts")
        before = self.counts.where(SHARED).select("key", F.lit(True).alias("was"))
        now = F.coalesce(F.expr(SHARED), F.lit(False)) & (F.col("refs") > 0)
        moves = fresh.join(before, "key", "left").select("key", F.pmod("shard_hash", F.lit(self.shards)).alias("shard"), now.alias("add"), F.coalesce("was", F.lit(False)).alias("was")).where("add != was")
        moves = common.stage_table(moves.select("shard", "key", "add"), "moves")
        if moves.count() > self.shards * SHARD_KEYS:  # more than the shards were made for
            return self._sharded([*self._postings, postings], [*self._counts, fresh])

        def apply(state: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            filt = Cuckoo.load(bytes(state["filter"].iloc[0])) if len(state) else Cuckoo(2 * len(pdf))
            filt.delete(list(pdf.loc[~pdf["add"].astype(bool), "key"]))
            filt.insert(list(pdf.loc[pdf["add"].astype(bool), "key"]))
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [filt.dump()], "full": [filt.full()]})

        asked = self.filters.join(moves.select("shard").distinct(), "shard", "left_semi")
        changed = common.stage_table(asked.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(apply, FILTERS), "new_filters")
        out = LineIndex([*self._postings, postings], [*self._counts, fresh], [*self._filters, changed], self.shards)
        full = changed.where("full").select("shard")
        if not full.isEmpty():
            if out.counts.where(SHARED).count() > 2 * self.shards * SHARD_KEYS:
                return self._sharded(out._postings, out._counts)
            keys = out.counts.where(SHARED).select("key", F.pmod("shard_hash", F.lit(self.shards)).alias("shard")).join(full, "shard", "left_semi")
            out._filters.append(common.stage_table(keys.groupBy("shard").applyInPandas(_fill, FILTERS), "larger_filters"))
        return out

    def compact(self) -> LineIndex:
        """The same index with one table of each kind."""
        return LineIndex(*([common.stage_table(t, name)] for t, name in ((self.postings, "postings"), (self.counts, "counts"), (self.filters, "filters"))), self.shards)

    def drops(self) -> DataFrame:
        """(doc_id, tk, keys): the keys that each document loses."""
        postings = self.postings.select("key", F.pmod("shard_hash", F.lit(self.shards)).alias("shard"), "doc_id", "tk")
        sizes = postings.groupBy("shard").agg(F.ceil(F.count("*") / PART).alias("parts"))
        sizes = common.small(common.stage_table(sizes.join(self.filters.select("shard"), "shard"), "shard_sizes"))
        part = F.pmod(F.xxhash64("doc_id", "tk"), F.col("parts")).alias("part")
        left = postings.join(sizes, "shard").select("shard", part, "key", "doc_id", "tk")
        shared = self.counts.where(SHARED).select(F.pmod("shard_hash", F.lit(self.shards)).alias("shard"), "key", "owner", F.lit(None).cast("binary").alias("filter"))
        held = shared.unionByName(self.filters.select("shard", "filter"), allowMissingColumns=True).join(sizes, "shard")
        held = held.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "key", "owner", "filter")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            filters = [f for f in right["filter"].to_pylist() if f is not None]
            if not filters or not len(left):
                return left.slice(0, 0).select(["doc_id", "tk", "key"])
            keys, ids = left["key"].to_pylist(), left["doc_id"].to_numpy()
            owners = {k: o for k, o in zip(right["key"].to_pylist(), right["owner"].to_pylist(), strict=True) if k is not None}
            maybe = np.flatnonzero(Cuckoo.load(filters[0]).contains(keys)).tolist()
            lost = [i for i in maybe if owners.get(keys[i], NO_ID) < ids[i]]
            return left.take(pa.array(lost, pa.int64())).select(["doc_id", "tk", "key"])

        lost = left.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(run, "doc_id long, tk long, key binary")
        return lost.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # no more than the document's lines


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped`` added.

    A null or empty text is one empty line and becomes empty. Rows with equal ids are
    one document, and null ids together stand for a document after all others. Columns
    named n_lines or n_dropped are replaced; all others are kept. An empty table gives an
    empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*own)
    drop = "drop"
    while drop in own:
        drop = f"_{drop}"
    drops = LineIndex.build(docs).drops().select(F.struct("doc_id", "tk").alias(f"{drop}_id"), F.col("keys").alias(drop))
    joined = docs.join(drops, F.struct(*_named(docs)) == F.col(f"{drop}_id"), "left").select(*own, drop)
    schema = common.with_fields(docs.schema, n_lines="bigint", n_dropped="bigint")

    def run(batches):
        for b in common.sliced(batches, "text"):
            texts, counts, dropped = [], [], []
            for text, gone in zip(b["text"].to_pylist(), b[drop].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(gone or ())
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                texts.append("\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            arrays = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in own]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest of what ``dedup`` keeps of every row of ``documents``; nulls, empty texts,
    repeated rows and empty tables as it says there."""
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id <> o.owner AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
