"""Mixing sources to target weights by systematic sampling.

Documents are laid end to end, source by source and by size within a source. Each
document is worth ``target / source size`` expected copies; the running sum of those
copies, plus one random offset per source, is cut at every integer, and a document
is emitted once for each integer its stretch crosses. Ordering by size makes every
stretch of the line hold documents of like size, so the words taken come close to
the target even when sizes have a long tail.

The running sum needs each document's rank within its source. Rows are dealt into
ranges of (source, size, id), so a hot source spans many ranges; a rank is the row's
place in its range plus the rows of earlier ranges. Only tables with a row per range
or per source are ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "quarry-mix"
OWN = ("size", "source_size", "target", "taken", "copies")


def offset(source):
    """A number in [0, 1) that depends on the source and the seed alone."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: its place in order, rows, size and target.

    Sources in code point order, null last, weigh ``weights``, repeating. They share
    ``share`` of all sizes by weight; a target stops at ``cap`` times its source's
    size and the excess is shared anew among the rest. That is ``weight * level`` with
    one level for all sources below their cap. With the sources in order of cap / weight
    and the first k of them at their caps, the rest share what is left; that level rises
    with k until no further source is above its cap and falls afterwards, so the level
    wanted is the largest. An empty table gives no rows; sources of size 0 get target 0.
    The windows here run over one row per source.
    """
    n = len(weights)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % n + 1).cast("int"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per_source.withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("w", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    )
    by_cap = Window.orderBy(F.col("most") / F.col("w"), "place")
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("most"), F.col("w") * F.col("level"))
    return ranked.select("source", "place", "start", "source_size", target.alias("target"))


def _placed(docs: DataFrame, columns: list[str], weights, share: float, cap: float) -> DataFrame:
    """(row, size, source_size, target, copies) of every document; ``row`` holds ``columns``, so none
    of them can clash with what is added."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*columns).alias("row"), "source", F.col("doc_id").alias("id"), size.alias("size"))
    if "text" not in columns:  # sizes are all that is carried on
        sized = common.stage_table(sized, "sizes")
    plan = common.stage_table(targets(sized.select("source", "size"), weights, share, cap), "targets")
    placed = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "p.place", "p.start", "p.source_size", "p.target")
        .repartitionByRange(common.partitions(spark), "place", "size", "id")
        .sortWithinPartitions("place", "size", "id")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("at", 33).cast("int"))
    )
    placed = common.stage_table(placed, "placed")
    blocks = placed.groupBy("block").agg(F.count("*").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("start")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"))
    out = placed.join(F.broadcast(blocks), "block")  # one row per range of the shuffle above
    copies = (F.floor((rank + 1) * each + u) - F.floor(rank * each + u)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Keeps every input row and column; a column named like one of the five added ones
    is replaced. A null or blank text has size 0 and takes no words however often it
    is emitted. Null sources form one source, last in order. Equal (size, doc_id) rows
    are told apart arbitrarily, but their totals are the same on every run. An empty
    table gives an empty result.
    """
    own = [c for c in docs.columns if c not in OWN]
    if set(own) == {"doc_id", "source", "text"}:  # the thin query
        own.remove("text")
    out = _placed(docs, own, weights, share, cap)
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as many times as it was taken, with its own columns, whatever
    they are called. Nulls, empty texts, repeated rows and empty tables are as ``mix`` says; a text
    without words is emitted as often as its place on the line tells."""
    out = _placed(docs, docs.columns, weights, share, cap)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of every row of ``documents``; nulls, empty texts, repeated rows and empty tables as it
    says there."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
c AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT source, source_size, least(most, w * max(lev) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
  ('0x' || substr(md5('quarry-mix' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor((k + 1) * e + u) - floor(k * e + u))::BIGINT * size AS taken FROM r
"""
