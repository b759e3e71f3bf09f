"""Conversation prefix trie: every prefix that conversations share, by ROLLUP over positional columns.

A turn becomes an id: two 64-bit hashes of its place and of the SHA-256 of its role and text. Eight
turns in a row are a block, a row with eight turn-id columns, keyed by the node that the block
before ended in; ROLLUP over the columns then makes all prefixes of all blocks at once, whatever
the conversations' lengths, and grouping_id tells their depths. A node's key is the sum of the ids
of its turns, so keys of blocks are running sums, which are made over ranges of (conversation,
place), and a conversation with very many turns is no single task.

What is summed over a subtree is laid on conversations first: a node's smallest member is a member
of all of its ancestors, so a node's own figure goes to that member at that depth, and a second
ROLLUP sums, at each node, what its members hold from its depth on.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turn-id columns of a block.
WIDTH = 8
#: Ids that make one text before a node's ids are put in a row.
CHUNK = 4096
#: Conversations of one family take their first turns from the family's first.
FAMILY = 100
KEY = ["depth", "ka", "kb"]


def running(rows: DataFrame, key: str, order: list[str], totals: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, the rows of the same ``key`` before each one in ``order``, and ``before_x``, the
    sums of those rows' x for each of ``totals``.

    Ranges of (key, order) are dealt out and written; sums are made within a range's part of a
    key, and a key that began in earlier ranges takes over what they hold. No table but that
    of the keys cut by a range's edge, fewer than there are ranges, is sent to every task.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(common.partitions(spark), key, *order).withColumn("range", F.spark_partition_id())
    dealt = common.stage_table(dealt, name)
    parts = dealt.groupBy("range", key).agg(F.count("*").alias("n"), *[F.sum(t).alias(f"sum_{t}") for t in totals])
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.select("range", key, F.sum("n").over(earlier).alias("cut_n"), *[F.sum(f"sum_{t}").over(earlier).alias(f"cut_{t}") for t in totals]).where("cut_n IS NOT NULL")
    here = Window.partitionBy("range", key).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("place", F.row_number().over(here) - 1)
    out = out.withColumns({f"before_{t}": F.coalesce(F.sum(t).over(so_far), F.lit(0)) for t in totals})
    out = out.join(F.broadcast(cut), ["range", key], "left").withColumn("place", F.col("place") + F.coalesce("cut_n", F.lit(0)))
    return out.withColumns({f"before_{t}": F.col(f"before_{t}") + F.coalesce(f"cut_{t}", F.lit(0)) for t in totals}).drop("range", "cut_n", *[f"cut_{t}" for t in totals])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, chars): turns by number, from 1, in order of ``turn``, null first, then role and
    text's digest; null roles and texts are empty. Rows without a conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return running(rows, "conv_id", ["turn", "role", "digest"], [], "turns").select("conv_id", (F.col("place") + 1).alias("n"), "digest", "chars")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): each conversation c with its first h turns replaced by those of
    c - c % 100, h being crc32(c) % 6. Every conversation has a row at place 0, without a turn."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rows = rows.withColumn("h", h.cast("int"))
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    firsts = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("n") <= 5)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("n", "digest", "chars"))).alias("firsts"))  # five turns
    heads = rows.where("n = 1").select("conv_id", "h", base).join(firsts, "base", "left")
    heads = heads.select("conv_id", "h", F.when((F.col("h") > 0) & F.col("firsts").isNotNull(), F.slice("firsts", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<struct<n:int,digest:string,chars:long>>")).alias("lead"))
    heads = common.stage_table(heads, "heads")
    lead = heads.select("conv_id", F.explode("lead").alias("t")).select("conv_id", F.col("t.n").cast("long").alias("pos"), "t.digest", "t.chars")
    short = common.stage_table(heads.where(F.size("lead") < F.col("h")).select("conv_id", F.size("lead").alias("m")), "short_leads")
    own = rows.where("n > h").join(common.small(short), "conv_id", "left")
    own = own.select("conv_id", (F.col("n") - F.col("h") + F.coalesce("m", "h")).cast("long").alias("pos"), "digest", "chars")
    none = heads.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("chars"))
    return lead.unionByName(own).unionByName(none)


def _ids(rows: DataFrame) -> DataFrame:
    """Rows with ``t``, the turn's id of two hashes (of its place and digest) and its length."""
    a, b = F.xxhash64("pos", "digest"), F.xxhash64(F.lit("second"), "pos", "digest")
    return rows.withColumn("t", F.when(F.col("pos") > 0, F.struct(a.alias("a"), b.alias("b"), "chars")))


def _wide(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def _columns(i: int) -> str:
    return f"t{i}"


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, t1 .. t8, pa, pb): blocks of each conversation with the key of the node before."""
    slot = (F.col("pos") - 1) % WIDTH + 1
    block = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / WIDTH).cast("long")
    wide = rows.groupBy("conv_id", block.alias("block")).agg(*[F.max(F.when(slot == i, F.col("t"))).alias(_columns(i)) for i in range(1, WIDTH + 1)], *[F.sum(_wide(F.col("t")[x])).alias(f"s{x}") for x in "ab"])
    out = running(wide, "conv_id", ["block"], ["sa", "sb"], "blocks")
    return out.select("conv_id", "block", *map(_columns, range(1, WIDTH + 1)), F.col("before_sa").cast("decimal(38,0)").alias("pa"), F.col("before_sb").cast("decimal(38,0)").alias("pb"))


def _rollup(blocks: DataFrame, figures: str) -> DataFrame:
    """``figures`` (SQL) for every prefix of the blocks that is a node, with its level in its block, its
    depth, its key and its last turn ``t``; a level without a turn is no node, and level 0 is one
    only as the root."""
    names = [_columns(i) for i in range(1, WIDTH + 1)]
    out = blocks.sparkSession.sql(f"SELECT block, pa, pb, {', '.join(names)}, cast({WIDTH} - log2(grouping_id() + 1) AS int) AS level, {figures} FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP({', '.join(names)})", blocks=blocks)
    last = F.coalesce(*[F.when(F.col("level") == i, F.col(_columns(i))) for i in range(1, WIDTH + 1)])
    key = [(F.col(f"p{x}") + sum((_wide(F.col(n)[x]) for n in names), F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)").alias(f"k{x}") for x in "ab"]
    out = out.withColumn("t", last).where("t IS NOT NULL OR level = 0 AND block = 0")
    return out.select("block", "level", (F.col("block") * WIDTH + F.col("level")).alias("depth"), *key, "t", *[c for c in out.columns if c not in ("block", "pa", "pb", "level", "t", *names)])


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, ka, kb, n_ends, ends_sha256) of the nodes that conversations end in.

    Ids become texts of up to ``CHUNK`` ids each, and a node's texts are hashed one after the
    other by one task that holds one of them: a digest can only be made in order.
    """
    ends = rows.groupBy("conv_id").agg(F.max("pos").alias("depth"), *[F.sum(_wide(F.col("t")[x])).cast("decimal(38,0)").alias(f"k{x}") for x in "ab"])
    chunk = F.floor(F.col("conv_id") / CHUNK)
    texts = ends.groupBy(*KEY, chunk.alias("chunk")).agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches):
        at, digest, n = None, None, 0
        for b in batches:
            out = []
            for *key, some, ids in zip(*(b[c].to_pylist() for c in (*KEY, "n", "ids")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, n, digest.hexdigest()))
                    at, digest, n = key, hashlib.sha256(), 0
                digest.update((("," if n else "") + ids).encode())
                n += some
            if out:
                yield _batch(out)
        if at is not None:
            yield _batch([(*at, n, digest.hexdigest())])

    kinds = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.string()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "n_ends", "ends_sha256"])

    sorted_ = texts.repartition(common.partitions(rows.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")
    return sorted_.mapInArrow(run, "depth long, ka decimal(38,0), kb decimal(38,0), n_ends long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Null conv_ids are left out; a null role or text is empty; turns of one number are in order of
    role, then of the text's digest; repeated rows are turns of their own. Conversations left
    without turns are members of the root. An empty table gives no nodes. Other columns are
    not read.
    """
    rows = common.stage_table(_ids(rebuilt(turns(conversations))), "rebuilt")
    blocks = common.stage_table(_blocks(rows), "trie_blocks")
    nodes = _rollup(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs")
    nodes = nodes.join(_ends(rows), KEY, "left").withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("t.chars", F.lit(0)))
    nodes = common.stage_table(nodes.withColumn("leaf", (F.col("n_convs") == F.coalesce("n_ends", F.lit(0))).cast("long")), "nodes")

    own = nodes.where("depth > 0").groupBy("conv_id", "block").agg(*[F.sum(F.when(F.col("level") == i, F.col("saved")).otherwise(0)).alias(f"w{i}") for i in range(1, WIDTH + 1)], F.sum("saved").alias("w"), F.sum("leaf").alias("leaf"), F.min("depth").alias("from"), F.max("depth").alias("to"))
    own = common.stage_table(running(own, "conv_id", ["block"], ["w"], "own_blocks").drop("place"), "own")
    total = own.groupBy("conv_id").agg(F.sum("w").alias("all"), F.sum("leaf").alias("leaves"), F.min("from").alias("from"), F.max("to").alias("to"))
    held = blocks.join(total, "conv_id").join(own.select("conv_id", "block", "before_w", *[f"w{i}" for i in range(1, WIDTH + 1)]), ["conv_id", "block"], "left")
    left, columns = F.col("all") - F.coalesce("before_w", F.lit(0)), {}
    for i in range(WIDTH + 1):  # what the member holds from level i on; whether it is the smallest of a child of level i
        left = left if i < 2 else left - F.coalesce(f"w{i - 1}", F.lit(0))
        columns[f"s{i}"] = left
        below = F.col("block") * WIDTH + i + 1
        columns[f"c{i}"] = ((F.col("from") <= below) & (below <= F.col("to"))).cast("long")
    held = held.select("block", "pa", "pb", *map(_columns, range(1, WIDTH + 1)), "leaves", *[v.alias(k) for k, v in columns.items()])
    sums = _rollup(held, ", ".join(["sum(leaves) AS leaves", *[f"sum({k}) AS {k}" for k in columns]]))
    of = lambda x: F.coalesce(*[F.when(F.col("level") == i, F.col(f"{x}{i}")) for i in range(WIDTH + 1)])
    sums = sums.select(*KEY, "leaves", of("s").alias("below"), of("c").alias("children"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    up = nodes.select("conv_id", *KEY, "n_convs", "leaf", "saved", "ends_sha256", *[(F.col(f"k{x}") - _wide(F.col("t")[x])).cast("decimal(38,0)").alias(f"p{x}") for x in "ab"])
    root = F.broadcast(parents.where("depth = 1").select("depth", "parent_conv_id"))  # one row
    kin = up.where("depth = 1").join(root, "depth").unionByName(up.where("depth > 1").join(parents, ["depth", "pa", "pb"])).unionByName(up.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = kin.join(sums, KEY, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", number(F.col("children")).alias("n_children"),
        F.when(F.col("leaf") == 1, 1).otherwise(number(F.col("leaves"))).cast("long").alias("n_leaves"),
        number(F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trie`` of all ``conversations``; nulls, ties, repeated rows and empty tables as it says there."""
    return trie(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: crc32 byte by byte: a byte is xored in, then -1 stands for each of its eight shifts.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({c}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x < 0 THEN xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) ELSE xor(a, x) END))"
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS b, {_CRC.format(c="conv_id")} % 6 AS h FROM t),
p AS (SELECT c, n AS o, 0 AS part, role, text FROM c JOIN t ON t.conv_id = b WHERE n <= h UNION ALL SELECT c, n, 1, role, text FROM c JOIN t ON t.conv_id = c WHERE n > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, o) AS d, role, text FROM p),
k AS (SELECT c, d, length(text) AS chars, sha256(list(length(role) || ':' || role || length(text) || ':' || text) OVER (PARTITION BY c ORDER BY d)::VARCHAR) AS k, count(*) OVER (PARTITION BY c) AS len FROM r
  UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM r WHERE r.c = c.c) FROM c),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '') AS ends, count(*) FILTER (len = d) AS n_ends FROM k GROUP BY 1, 2),
up AS (SELECT DISTINCT a.d, a.k, b.k AS pk FROM k a JOIN k b ON a.c = b.c AND b.d = a.d - 1),
under AS (SELECT DISTINCT a.d, a.k, b.d AS vd, b.k AS vk FROM k a JOIN k b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT under.d, under.k, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens, count(*) FILTER (v.n_ends = v.n_convs) AS n_leaves, count(*) FILTER (vd = under.d + 1) AS n_children FROM under JOIN nodes v ON v.d = vd AND v.k = vk GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs AS n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN s USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN nodes q ON q.d = n.d - 1 AND q.k = up.pk
"""
