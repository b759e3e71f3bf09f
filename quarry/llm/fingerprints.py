"""Document fingerprints as threshold-scaled sketches, in DataFrame functions alone.

A text's sketch is the set of hashes of its 5-word shingles that lie below a fixed
fraction of the hash range, plus its least hash, so that no sketch of a text with words
is empty. Since the threshold is the same for all, the sketch of a union is the union
of sketches (less the least hashes above the threshold), and the share of the smaller
sketch found in the other estimates containment however unequal the documents are.
Where the smaller text has no hash below the threshold, its least hash is looked up among
all hashes of the other, whose sketch need not hold it; the texts are at hand for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: Keep hashes whose top bits are zero: one in 2 ** SCALE.
SCALE = 2
LIMIT = 1 << (63 - SCALE)
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def hashed(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``__w``, the words of ``text``, and ``__h``, the hashes of its shingles."""
    w = F.col("__w")
    hashes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(SHINGLE)]).bitwiseAND(F.lit((1 << 63) - 1)),
    )
    return df.withColumn("__w", common.word_array(common.ascii_lower(text))).withColumn("__h", hashes)


def sketched(df: DataFrame, text: str, out: str, sought: Column | None = None) -> DataFrame:
    """``df`` with ``out``: the sorted sketch of column ``text``, as an array of longs, with
    ``out``_n, the number of its shingles, and ``out``_has, whether ``sought`` is one's hash.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer
    than five words is one shingle; a null or blank text has an empty sketch.
    """
    some = F.size("__w") > 0
    df = hashed(df, F.col(text))
    kept = F.array_union(F.filter("__h", lambda h: h < LIMIT), F.array(F.array_min("__h")))
    df = df.withColumn(out, F.when(some, F.sort_array(kept)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(f"{out}_n", F.when(some, F.size(F.array_distinct("__h"))).otherwise(0))
    if sought is not None:
        df = df.withColumn(f"{out}_has", F.coalesce(some & F.array_contains("__h", sought), F.lit(False)))
    return df.drop("__w", "__h")


def holds(df: DataFrame, text: str, sought: Column, out: str) -> DataFrame:
    """``df`` with ``out``: whether hash ``sought`` is of a shingle of ``text``; only asked where not null."""
    df = hashed(df, F.when(sought.isNotNull(), F.col(text)))
    return df.withColumn(out, F.coalesce((F.size("__w") > 0) & F.array_contains("__h", sought), F.lit(False))).drop("__w", "__h")


def lone(sketch: Column) -> Column:
    """The least hash of a text that has none below the threshold, else null."""
    first = F.try_element_at(sketch, F.lit(1))
    return F.when(first >= LIMIT, first)


def written(sketch: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def containment(a: Column, b: Column, n: Column, m: Column, a_in_b: Column, b_in_a: Column) -> Column:
    """Estimated share of the smaller text's shingles in the other; 1 for two empty texts.

    ``n`` and ``m`` count their shingles; ``a_in_b`` tells whether the lone hash of the first
    is among all of the second, ``b_in_a`` the reverse.
    """
    least = F.least(F.size(a), F.size(b))
    one = F.when((n <= m) & lone(a).isNotNull(), a_in_b.cast("double")).when((m <= n) & lone(b).isNotNull(), b_in_a.cast("double"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(F.coalesce(one, F.size(F.array_intersect(a, b)) / least))


KEY = ("id", "tk")


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, tk, text): a null id is set to NO_ID, after all others; ``tk`` tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text, F.char_length(text)).alias("tk"), text.alias("text"))


def followers(docs: DataFrame) -> DataFrame:
    """(id, tk, copies, next): how many rows have a key, and the key of the next document by ascending id,
    the first after the last. Rows without an id follow none and are followed by the first, or by themselves if no row has one.

    Keys are dealt into ranges; the follower of a range's last key is the least key of the
    next range that has one, which a table of one row per range tells.
    """
    key = F.struct(*KEY)
    keys = _keyed(docs).groupBy(*KEY).agg(F.count("*").alias("copies"))
    nameless, keys = keys.where(F.col("id") == NO_ID), keys.where(F.col("id") != NO_ID)
    ranged = keys.repartitionByRange(common.partitions(docs.sparkSession), *KEY).withColumn("block", F.spark_partition_id())
    ranged = common.stage_table(ranged, "ranged_ids")
    firsts = ranged.groupBy("block").agg(F.min(key).alias("first"))
    firsts = firsts.select("block", F.coalesce(F.lead("first").over(Window.orderBy("block")), F.min("first").over(Window.partitionBy())).alias("after"))
    ahead = F.lead(key).over(Window.partitionBy("block").orderBy(*KEY))
    named = ranged.withColumn("ahead", ahead).join(F.broadcast(firsts), "block").select(*KEY, "copies", F.coalesce("ahead", "after").alias("next"))
    first = F.broadcast(ranged.agg(F.min(key).alias("first")))  # one row
    return named.unionByName(nameless.crossJoin(first).select(*KEY, "copies", F.coalesce("first", key).alias("next")))


def compare(docs: DataFrame) -> DataFrame:
    """Sketches of every text and its edited text, and their likenesses, for every row.

    A null text is empty. Rows without an id are placed as ``followers`` says. Different texts
    of one id follow one another in the order of their hashes; repeated rows are one document
    in that order and get equal results. A single document is its own next one. Other
    columns are ignored; an empty table gives an empty result.
    """
    order = common.stage_table(followers(docs), "followers")
    base = _keyed(docs).groupBy(*KEY).agg(F.max("text").alias("text"))  # the same columns wherever it is read, so texts are shuffled once
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    sk = sketched(base, "text", "sketch")
    before = sk.join(order, list(KEY)).select(F.col("next.id").alias("id"), F.col("next.tk").alias("tk"), F.col("id").alias("before_id"), F.col("tk").alias("before_tk"), "copies", quarter.alias("take"), lone(F.col("sketch")).alias("sought"))
    heads = holds(sk.join(before, list(KEY)), "text", F.col("sought"), "in_next")
    heads = heads.select(F.col("before_id").alias("id"), F.col("before_tk").alias("tk"), "copies", F.substring("text", F.lit(1), F.col("take")).alias("head"), F.col("sketch").alias("next_sketch"), F.col("sketch_n").alias("next_n"), "in_next")
    both = holds(sk.join(heads, list(KEY)), "text", lone(F.col("next_sketch")), "next_in")
    chars = F.char_length("text")
    both = both.withColumn("n_chars", chars.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), (chars - F.floor(chars / 4)).cast("int")), F.col("head"))).drop("head")
    out = sketched(both, "edited", "edited_sketch", lone(F.col("sketch")))
    out = holds(out, "text", lone(F.col("edited_sketch")), "edited_in").drop("text")
    c = F.col
    out = out.withColumn("near_edited", containment(c("sketch"), c("edited_sketch"), c("sketch_n"), c("edited_sketch_n"), c("edited_sketch_has"), c("edited_in")))
    out = out.withColumn("near_next", containment(c("sketch"), c("next_sketch"), c("sketch_n"), c("next_n"), c("in_next"), c("next_in")))
    out = out.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema["doc_id"].dataType))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(*KEY, "copies", "copy")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compare`` of every row of ``documents``, sketches as text; nulls, empty texts, repeated rows and
    empty tables as it says there."""
    out = compare(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
