"""The catalogue's node and edge tables: made from staged parts, merged load by load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..sources.ledger import write_measured
from .enrich import PARAMETERS, enriched, last_wins, promoted, upsert

NODES = ("part", "manufacturer", "category", "package", "datasheet", "tag", "attr_value")
EDGES = ("made_by", "in_category", "in_package", "datasheet_of", "tagged", "attr")


def normalise(staged: DataFrame, source_ref: str) -> DataFrame:
    """Staged parts with attributes enriched, typed parameters, tags and ``source_ref``.

    Tags already there stay first; a parameter already there wins over one read from an
    attribute. Everything is read row by row, without a shuffle.
    """
    rows = staged.withColumn("attributes", F.flatten(F.transform("attributes", lambda a: enriched(a["name"], a["value_text"]))))
    read = rows.withColumn("__read", promoted(F.col("attributes")))
    own = F.coalesce("promoted", F.create_map().cast("map<string,double>"))
    kept = F.map_concat(own, F.map_filter("__read", lambda k, v: ~F.map_contains_key(own, k)))
    found = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), exprs.tags(F.col("description")))
    return read.withColumn("promoted", kept).withColumn("tags", found).withColumn("source_ref", F.lit(source_ref)).drop("__read")


#: Stands between a part's key and its source number; no key holds it.
LISTED = "@"


def listings(staged: DataFrame) -> DataFrame:
    """Staged parts keyed by ``xid`` and the source's number, for tables with a row for each part that
    the source lists: numbers that differ in nothing but where they are parted, such as A1-23
    and A12-3, have one ``xid``. ``part_key`` gives the key without it."""
    return staged.withColumn("xid", F.concat("xid", F.lit(LISTED), F.coalesce("lcsc_id", F.lit(""))))


def part_key(listed: Column) -> Column:
    """The ``xid`` of a part whose key is that of ``listings``."""
    return F.substring_index(listed, LISTED, 1)


def entity_tables(staged: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables of normalised parts, by name. Of rows with one ``xid`` the last by
    ``lcsc_id`` gives the scalars; edges of all of them count."""
    scalars = ("mpn", "mpn_norm", "description", "lcsc_id", "stock", "is_basic", "price_usd")
    rows = staged.select("xid", *scalars, *[F.col("promoted")[p].alias(p) for p in PARAMETERS], F.array("source_ref").alias("source_refs"))
    sub = F.when(F.col("subcategory").isNotNull(), F.col("category"))
    name = F.coalesce("subcategory", "category")
    attrs = staged.select("xid", F.explode("attributes").alias("a")).select("xid", F.col("a.name").alias("attr_name"), F.col("a.value_text").alias("attr_value"), F.col("a.value_num").alias("attr_value_num"))

    def names(c: str) -> DataFrame:
        return staged.select(F.col(c).alias("name")).where("name IS NOT NULL").distinct()

    def edges(**columns) -> DataFrame:
        return staged.select("xid", *[v.alias(k) for k, v in columns.items()]).where(f"{list(columns)[-1]} IS NOT NULL").distinct()

    level1 = staged.select(F.lit(None).cast("string").alias("parent_name"), F.col("category").alias("name"))
    level2 = staged.select(F.col("category").alias("parent_name"), F.col("subcategory").alias("name"))
    sheets = staged.where("datasheet_url IS NOT NULL").groupBy(F.col("datasheet_url").alias("url")).agg(F.max("source_ref").alias("source"))
    return {
        "part": last_wins(rows, "xid", "lcsc_id"),
        "manufacturer": names("mfr_name"),
        "package": names("package"),
        "tag": staged.select(F.explode("tags").alias("name")).distinct(),
        "category": level1.unionByName(level2).where("name IS NOT NULL").distinct(),
        "datasheet": sheets.withColumns({"verified_at": F.lit(None).cast("timestamp"), "http_status": F.lit(None).cast("int"), "fail_count": F.lit(None).cast("int")}),
        "attr_value": attrs.groupBy("attr_name", "attr_value").agg(F.max("attr_value_num").alias("attr_value_num")),
        "made_by": edges(name=F.col("mfr_name")),
        "in_category": edges(parent_name=sub, name=name),
        "in_package": edges(name=F.col("package")),
        "datasheet_of": edges(url=F.col("datasheet_url")),
        "tagged": staged.select("xid", F.explode("tags").alias("name")).distinct(),
        "attr": attrs.select("xid", "attr_name", "attr_value").distinct(),
    }


def merge(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a load: new scalars where they are not null, ``is_basic`` always, sources and
    edges united and never removed, a datasheet's source the newest. Twice is once."""
    out = {}
    for k, fresh in new.items():
        if k == "part":
            out[k] = upsert(old[k], fresh, "xid", always=("is_basic",), sets=("source_refs",))
        elif k == "datasheet":
            out[k] = upsert(old[k], fresh, "url")
        elif k == "attr_value":
            both = old[k].unionByName(fresh)
            out[k] = both.groupBy("attr_name", "attr_value").agg(F.max("attr_value_num").alias("attr_value_num"))
        else:
            out[k] = old[k].unionByName(fresh).distinct()
    return out


def node_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(type, n) for every node type, those without nodes too."""
    counts = [tables[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("type"), "n") for k in NODES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def write(tables: dict[str, DataFrame], path: str) -> dict[str, float]:
    """Write all tables under the new folder ``path``; what the load of parts took."""
    for k in (*NODES[1:], *EDGES):
        tables[k].write.parquet(f"{path}/{k}")
    return write_measured(tables["part"], f"{path}/part")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{path}/{k}") for k in (*NODES, *EDGES)}


def ingest(staged: DataFrame, source_ref: str, path: str, before: str | None = None) -> dict[str, float]:
    """One load: normalise, make the tables, merge them with those under ``before``, write them
    under ``path``."""
    tables = entity_tables(normalise(staged, source_ref))
    if before is not None:
        tables = merge(read(staged.sparkSession, before), tables)
    return write(tables, path)
