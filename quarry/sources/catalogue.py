"""The component catalogue: raw tables in their two shapes, staged parts, and a view over star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs

# The columns of a staged part, in the order of their names in JSON.
STAGED = {
    "attributes": "array<struct<name:string,value_text:string,value_num:double,unit:string>>", "category": "string", "datasheet_url": "string", "description": "string",
    "is_basic": "boolean", "lcsc_id": "string", "mfr_name": "string", "mfr_norm": "string", "mpn": "string", "mpn_norm": "string", "package": "string", "price_usd": "double",
    "promoted": "map<string,double>", "source_ref": "string", "stock": "bigint", "subcategory": "string", "tags": "array<string>", "xid": "string",
}


def _rows(components: DataFrame, manufacturers: DataFrame | None, categories: DataFrame | None) -> DataFrame:
    """Rows of either shape under common names; which of them are orphans; no row left out.

    Known columns that are absent are null. Raises ValueError for any other shape.
    """
    have = set(components.columns)
    of = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).try_cast(kind).alias(c)
    shared = [of(c) for c in ("description", "package", "datasheet", "price", "extra")]
    stock = of("stock", "double").cast("bigint").alias("stock")
    if "lcsc" in have and {"mpn", "manufacturer"} <= have:
        basic = F.coalesce(of("is_basic", "int"), F.lit(0)) != 0
        return components.select(*shared, stock, F.col("mpn").cast("string").alias("own"), of("manufacturer").alias("mfr_name"), of("category"), of("subcategory"), F.col("lcsc").cast("string").alias("lcsc_id"), basic.alias("is_basic"), F.lit(0).alias("orphans"), F.lit(False).alias("keyed"))
    if {"lcsc", "mfr", "manufacturer_id", "category_id"} <= have and manufacturers is not None and categories is not None:
        basic = F.coalesce(of("basic", "int"), F.lit(0)) != 0
        rows = components.select(*shared, stock, F.col("mfr").cast("string").alias("own"), "manufacturer_id", "category_id", F.concat(F.lit("C"), F.col("lcsc").cast("string")).alias("lcsc_id"), basic.alias("is_basic"))
        rows = rows.join(manufacturers.select(F.col("id").alias("manufacturer_id"), F.col("name").alias("mfr_name")), "manufacturer_id", "left")
        rows = rows.join(categories.select(F.col("id").alias("category_id"), "category", "subcategory"), "category_id", "left")
        orphan = lambda key, name: (F.col(key).isNotNull() & F.col(name).isNull()).cast("int")
        return rows.withColumn("orphans", orphan("manufacturer_id", "mfr_name") + orphan("category_id", "category")).withColumn("keyed", F.lit(True)).drop("manufacturer_id", "category_id")
    raise ValueError(f"unknown catalogue shape: {sorted(have)}")


def _part_number(extra) -> F.Column:
    """The row's own number if it is not blank, in the keyed shape else that of ``extra``."""
    other = F.when(F.col("keyed") & (F.trim(extra["mpn"]) != ""), extra["mpn"])
    return F.coalesce(F.when(F.trim("own") != "", F.col("own")), other)


def _figures(skip: Column, corrupt: Column) -> dict[str, Column]:
    """Rows skipped for want of a number, corrupt ``extra`` fields of any row, and orphaned keys of the
    rows kept (a row may have two)."""
    return {"skipped_empty_mpn": F.count_if(skip), "corrupt_extra": F.count_if(corrupt), "fk_orphan": F.coalesce(F.sum(F.when(~skip, F.col("orphans"))), F.lit(0))}


def staged(components: DataFrame, manufacturers: DataFrame | None = None, categories: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """Components of either shape - the flat one, or the one with foreign keys - as staged parts.

    Rows without a part number are left out. Attributes are as written, tags, parameters and
    source are for ``normalise`` to fill in. ``seen`` gets the figures of ``quality`` when the
    result is first written, so that no second pass is needed for them.
    """
    rows = _rows(components, manufacturers, categories).withColumn("decoded", exprs.extra(F.col("extra")))
    rows = rows.withColumn("mpn", _part_number(F.col("decoded")))
    if seen is not None:
        rows = rows.observe(seen, *[v.alias(k) for k, v in _figures(F.col("mpn").isNull(), exprs.corrupt(F.col("extra"))).items()])
    rows = rows.where("mpn IS NOT NULL")
    none = F.lit(None)
    records = F.transform(exprs.attribute_records(F.col("decoded.attributes")), lambda a: F.struct(a["name"].alias("name"), a["value_text"].alias("value_text"), none.cast("double").alias("value_num"), none.cast("string").alias("unit")))
    made = {
        "attributes": records, "datasheet_url": F.col("datasheet"), "mfr_norm": exprs.normalize(F.col("mfr_name")), "mpn_norm": exprs.normalize(F.col("mpn")), "price_usd": exprs.tier_price(F.col("price")),
        "promoted": F.create_map().cast(STAGED["promoted"]), "source_ref": F.lit(""), "tags": F.array().cast("array<string>"), "xid": exprs.part_key(F.col("mpn"), F.col("mfr_name")),
    }
    return rows.select(*[made.get(c, F.col(c)).cast(t).alias(c) for c, t in STAGED.items()])


def quality(components: DataFrame, manufacturers: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """One row of figures alone, for a look at a catalogue that is not loaded (see ``staged``)."""
    rows = _rows(components, manufacturers, categories)
    rows = rows.select(_part_number(exprs.extra(F.col("extra"))).isNull().alias("skip"), exprs.corrupt(F.col("extra")).alias("corrupt"), "orphans")
    return rows.agg(*[v.alias(k) for k, v in _figures(F.col("skip"), F.col("corrupt")).items()])


def write_staged(rows: DataFrame, path: str) -> None:
    """Staged parts as JSON lines in the order of (lcsc_id, xid), keys in order: the same rows give
    the same lines. The one global sort is what an export is for."""
    rows.select(*STAGED).orderBy(F.coalesce("lcsc_id", F.lit("")), "xid", F.to_json(F.struct(*STAGED))).write.json(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Staged parts of JSON lines: blank lines are skipped, absent lists, maps and flags are empty."""
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in STAGED.items())).json(path).where("xid IS NOT NULL")
    empty = {"attributes": F.array(), "tags": F.array(), "promoted": F.create_map(), "is_basic": F.lit(False), "source_ref": F.lit("")}
    return rows.select(*[(F.coalesce(c, empty[c].cast(t)).alias(c) if c in empty else F.col(c)) for c, t in STAGED.items()])


def first_parts(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` staged parts by (lcsc_id, xid), for development."""
    if n <= 0:
        raise ValueError("n must be positive")
    return rows.orderBy(F.coalesce("lcsc_id", F.lit("")), "xid").limit(n)


def bare_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue parts seen in the star-schema tables, without their stock."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    mpn = F.concat("p_brand", F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return part.select(
        "p_partkey", mpn.alias("mpn"), exprs.normalize(mpn).alias("mpn_norm"), exprs.part_key(mpn, F.col("p_brand")).alias("xid"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("description"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("package"), F.col("p_retailprice").alias("price_usd"), (F.col("p_size") % 3 == 0).alias("is_basic"), F.col("p_size").cast("double").alias("resistance"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bare_parts`` with stock, which is what a part's line items sum up to."""
    stock = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("stock"))
    return bare_parts(spark, sf_dir).join(stock, "p_partkey", "left")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, pos, name, value_text): three attribute texts for every part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    prefix = F.element_at(F.array(*map(F.lit, "kMmµn")), (F.col("p_partkey") % 5 + 1).cast("int"))
    texts = F.array(
        F.struct(F.lit("Resistance").alias("name"), F.concat(size, prefix, F.lit("Ω")).alias("value_text")),
        F.struct(F.lit("Output Current (max)").alias("name"), F.concat(size, F.lit("mA~"), (F.col("p_size") + 5).cast("string"), F.lit("A")).alias("value_text")),
        F.struct(F.lit("Supply Voltage").alias("name"), F.concat(size, F.lit("V@1mA")).alias("value_text")),
    )
    return part.select("p_partkey", F.posexplode(texts).alias("pos", "a")).select("p_partkey", "pos", "a.name", "a.value_text")


#: A raw component table with foreign keys over ``part``: blank numbers, corrupt fields, orphans.
#: As SQL that Spark and DuckDB read alike.
RAW = (
    "p_partkey AS lcsc",
    "CASE WHEN p_partkey % 10 < 2 THEN ' ' ELSE concat(p_brand, '-', CAST(p_partkey AS STRING)) END AS mfr",
    "p_partkey % 7 AS manufacturer_id",
    "p_partkey % 5 AS category_id",
    "concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN ' rs232 usb' ELSE '' END) AS description",
    "lpad(CAST(p_size AS STRING), 4, '0') AS package",
    "CASE WHEN p_partkey % 3 > 0 THEN concat('https://ds.example.com/', CAST(p_partkey % 100 AS STRING)) END AS datasheet",
    "p_size * 10 AS stock",
    "CAST(p_size AS STRING) AS price",
    "CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS basic",
    """CASE WHEN p_partkey % 10 = 0 THEN concat('{"mpn": "X-', CAST(p_partkey AS STRING), '"}') WHEN p_partkey % 10 = 2 THEN 'not json' WHEN p_partkey % 10 = 3 THEN '[1]' WHEN p_partkey % 10 = 4 THEN ''
  ELSE concat('{"attributes": {"Resistance": "', CAST(p_size AS STRING), 'kΩ", "Supply Voltage": {"primary": "', CAST(p_size AS STRING), 'V"}, "odd": [1]}}') END AS extra""",
)


def raw_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, manufacturers and categories in the shape with foreign keys."""
    part, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation", "region"))
    makers = nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    kinds = region.where("r_regionkey <> 4").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("category"), F.expr("CASE WHEN r_regionkey > 0 THEN concat('sub ', CAST(r_regionkey AS STRING)) END").alias("subcategory"))
    return part.selectExpr(*RAW), makers, kinds
