"""Attribute enrichment, promotion to typed parameters, dedup and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

# Attribute name -> promoted parameter.
PROMOTIONS = {
    "resistance": "resistance", "capacitance": "capacitance", "inductance": "inductance", "power": "power", "power dissipation": "power",
    "tolerance": "tolerance_pct", "frequency": "frequency_max", "clock frequency": "frequency_max", "output current": "current_max",
    "supply current": "current_max", "standby current": "current_max", "current": "current_max", "overload voltage": "voltage_max",
    "maximum input voltage": "voltage_max", "max voltage": "voltage_max", "minimum input voltage": "voltage_min", "min voltage": "voltage_min",
}
# The typed parameters.
PARAMETERS = ("voltage_min", "voltage_max", "current_max", "resistance", "capacitance", "inductance", "frequency_max", "power", "tolerance_pct")


def enriched(name: Column, text: Column) -> Column:
    """array<struct(name, value_text, value_num, unit)> of one attribute.

    A range keeps its row, without a number, and gains a (min) and a (max) row if both ends
    can be read; a list of several readable values gains a row for each; any other value is
    read in place. Only rows with a number have a unit. Each text is read once.
    """
    ranged, many = F.contains(text, F.lit("~")), F.contains(text, F.lit(";"))
    pieces = F.when(ranged, F.array(F.substring_index(text, "~", 1), F.substring(text, F.instr(text, "~") + 1, F.length(text)))).when(many, F.concat(F.transform(F.split(text, ";"), F.trim), F.array(text))).otherwise(F.array(text))
    symbol = exprs.unit(name)

    def row(n: Column, t: Column, v: Column) -> Column:
        return F.struct(n.alias("name"), t.alias("value_text"), v.alias("value_num"), F.when(v.isNotNull(), symbol).alias("unit"))

    def made(read: Column) -> Column:
        whole = F.try_element_at(read, F.lit(-1))
        low, high = F.try_element_at(read, F.lit(1))["v"], F.try_element_at(read, F.lit(2))["v"]
        bare = F.array(row(name, text, F.lit(None).cast("double")))
        listed = F.filter(F.slice(read, 1, F.greatest(F.size(read) - 1, F.lit(0))), lambda s: s["v"].isNotNull())
        ends = F.array(row(F.concat(name, F.lit(" (min)")), text, low), row(F.concat(name, F.lit(" (max)")), text, high))
        return (
            F.when(ranged, F.when(low.isNotNull() & high.isNotNull(), F.concat(bare, ends)).otherwise(bare))
            .when(many & (F.size(listed) > 1), F.concat(bare, F.transform(listed, lambda s: row(name, s["t"], s["v"]))))
            .otherwise(F.array(row(name, text, whole["v"])))
        )

    return exprs.let(F.transform(pieces, lambda t: F.struct(t.alias("t"), exprs.magnitude(t).alias("v"))), made)


def enrich(attributes: DataFrame) -> DataFrame:
    """``attributes`` (pos, name, value_text, ...) with ``sub_pos``, ``value_num`` and ``unit``, as
    ``enriched`` makes of each; other columns are kept."""
    keep = [c for c in attributes.columns if c not in ("name", "value_text")]
    rows = attributes.select(*keep, F.posexplode(enriched(F.col("name"), F.col("value_text"))).alias("sub_pos", "m"))
    return rows.select(*keep, "sub_pos", "m.*")


def promoted(records: Column) -> Column:
    """map<parameter, value> of enriched records in their order: of each parameter the first value."""
    table = F.create_map(*[F.lit(x) for kv in PROMOTIONS.items() for x in kv])
    read = F.filter(F.transform(records, lambda r: F.struct(F.try_element_at(table, exprs.attr_name(r["name"])).alias("key"), r["value_num"].alias("value"))), lambda r: r["key"].isNotNull() & r["value"].isNotNull())

    def firsts(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda r: r["key"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(found, lambda r: r["key"] == n), 1)["value"]))

    return exprs.let(read, firsts)


def promote(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` with the typed parameters: of each, the first readable value."""
    table = F.create_map(*[F.lit(x) for kv in PROMOTIONS.items() for x in kv])
    named = rows.withColumn("parameter", F.try_element_at(table, exprs.attr_name(F.col("name")))).where("value_num IS NOT NULL AND parameter IS NOT NULL")
    order = F.struct("pos", "sub_pos")
    return named.groupBy(key).agg(*[F.min_by(F.when(F.col("parameter") == p, F.col("value_num")), F.when(F.col("parameter") == p, order)).alias(p) for p in PARAMETERS])


def last_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The row of each key that is last by ``order``, ties broken by all columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, always: tuple[str, ...] = (), sets: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge: new values where not null, ``always`` columns whenever a new row is
    there, ``sets`` united."""
    o, n = old.alias("o"), new.alias("n")
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in (c for c in old.columns if c != key):
        if c in sets:
            empty = F.array().cast(old.schema[c].dataType)
            out.append(F.array_sort(F.array_union(F.coalesce(f"o.{c}", empty), F.coalesce(f"n.{c}", empty))).alias(c))
        elif c in always:
            out.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)
