"""Loads into the catalogue's tables: resumable, seen only when whole, writing only what they touch.

Under a root, ``loads/<number>-<load>/<table>`` holds what a load wrote, and ``manifests/<number>``,
written last, names for every table the folders that make it up: one with all rows, then one
for each later load with the rows of the keys that it touched. Whoever reads goes through the
newest manifest, so a load that broke is not seen. Started again, it keeps the tables that it
had finished and makes the others; a load that is in a manifest is not done again. One load
runs at a time. Once the later folders of a table hold a tenth of its rows they become one.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .enrich import upsert
from .tables import EDGES, NODES, entity_tables, normalise

#: The key of a table; all columns where none is named.
KEYS = {"part": ["xid"], "datasheet": ["url"], "attr_value": ["attr_name", "attr_value"]}
#: Share of a table's rows that later folders may hold.
LOOSE = 0.1
#: Rows of keys that may be sent to every task.
FEW = 200_000
#: Tables that are written at the same time.
TOGETHER = 6
MANIFEST = "seq long, load string, table string, path string, rows long, added long"


def same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """``key`` is equal in both, null being equal to null."""
    out = F.lit(True)
    for c in key:
        out = out & a[c].eqNullSafe(b[c])
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _written(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> tuple[int, list]:
        """The newest manifest's number, 0 if there is none, and its rows: a few for each table."""
        if not self._written(f"{self.root}/manifests"):
            return 0, []
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.root}/manifests")
        newest = rows.agg(F.max("seq").alias("seq")).first()["seq"] or 0
        return newest, rows.where(F.col("seq") == newest).collect() if newest else []

    def loads(self) -> set[str]:
        if not self._written(f"{self.root}/manifests"):
            return set()
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.root}/manifests")
        return {r["load"] for r in rows.select("load").distinct().collect()}  # one a load

    def _table(self, rows: list, table: str) -> DataFrame | None:
        paths = [r["path"] for r in rows if r["table"] == table]
        if not paths:
            return None
        base = self.spark.read.parquet(f"{self.root}/{paths[0]}")
        if len(paths) == 1:
            return base
        later = None
        for i, p in enumerate(paths[1:]):
            one = self.spark.read.parquet(f"{self.root}/{p}").select(*base.columns, F.lit(i).alias("__seq"))
            later = one if later is None else later.unionByName(one)
        if table not in KEYS:
            return base.unionByName(later.drop("__seq"))  # no row is in two folders
        key, rest = KEYS[table], [c for c in base.columns if c not in KEYS[table]]
        newest = later.groupBy(*key).agg(F.max_by(F.struct(*rest), "__seq").alias("__r")).select(*key, *[F.col("__r")[c].alias(c) for c in rest])
        keys = later.select(*key).distinct()
        n = sum(r["rows"] for r in rows if r["table"] == table and r["path"] != paths[0])
        return base.join(F.broadcast(keys) if n <= FEW else keys, same(base, keys, key), "left_anti").unionByName(newest)

    def read(self) -> dict[str, DataFrame]:
        """The tables of the newest whole load."""
        _, rows = self.manifest()
        return {t: self._table(rows, t) for t in (*NODES, *EDGES) if any(r["table"] == t for r in rows)}

    def node_counts(self) -> dict[str, int]:
        """Nodes of each type, as counted when they were written; no table is read."""
        _, rows = self.manifest()
        return {t: sum(r["added"] for r in rows if r["table"] == t) for t in NODES}

    def _once(self, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written under ``path`` unless a finished write is there already."""
        if not self._written(f"{self.root}/{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{self.root}/{path}")
        return self.spark.read.parquet(f"{self.root}/{path}")

    def _touched(self, table: str, old: DataFrame, new: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
        """Rows that a load adds to or changes in ``old``, and the rows of ``old`` that they replace.

        ``new`` has ``n`` rows at most; if they are few they go to the old rows, of which only
        those met are moved.
        """
        key = KEYS.get(table, new.columns)
        keys = new.select(*key).distinct()
        met = old.join(F.broadcast(keys) if n <= FEW else keys, same(old, keys, key), "left_semi")
        if table == "part":
            return upsert(met, new, "xid", always=("is_basic",), sets=("source_refs",)), met
        if table == "datasheet":
            return upsert(met, new, "url"), met
        if table == "attr_value":
            return met.unionByName(new).groupBy(*key).agg(F.max("attr_value_num").alias("attr_value_num")), met
        return new.join(met, same(new, met, key), "left_anti"), None

    def load(self, staged: DataFrame, load: str, source_ref: str, seen: Observation | None = None) -> dict:
        """Merge staged parts into the tables, as ``tables.merge`` does: parts_loaded, wall_seconds,
        parts_per_second and what ``seen``, observed on the way (see ``catalogue.staged``), has found.

        ``load`` names the load and what is in it; of one that is done already nothing is read.
        """
        if not re.fullmatch(r"[A-Za-z0-9._-]+", load):
            raise ValueError("a load's name has letters, digits, dots, dashes and underscores")
        began = time.monotonic()
        if load in self.loads():
            return {"parts_loaded": 0, "wall_seconds": time.monotonic() - began, "parts_per_second": 0.0, "repeated": True}
        seq, before = self.manifest()
        at = f"loads/{seq + 1}-{load}"
        fresh = not self._written(f"{self.root}/{at}/normalised/_SUCCESS")
        rows = self._once(f"{at}/normalised", lambda: normalise(staged, source_ref))
        n, made = rows.count(), entity_tables(rows)  # counted from the files' footers
        add = lambda table: self._add(table, made[table], n, [r for r in before if r["table"] == table], f"{at}/{table}")
        with ThreadPoolExecutor(TOGETHER) as pool:  # tables do not depend on each other
            entries = [(seq + 1, load, *e) for some in pool.map(add, made) for e in some]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifests/{seq + 1:08d}")
        took = time.monotonic() - began
        return {"parts_loaded": n, "wall_seconds": took, "parts_per_second": n / max(took, 1e-9), "repeated": False} | (seen.get if seen is not None and fresh else {})

    def _add(self, table: str, new: DataFrame, n: int, before: list, path: str) -> list[tuple]:
        """Manifest entries (table, path, rows, added) of ``table`` after a load wrote under ``path``."""
        kept = [(table, r["path"], r["rows"], r["added"]) for r in before]
        if not before:
            count = self._once(path, lambda: new).count()
            return [(table, path, count, count)]
        old = self._table(before, table)
        most = n * (1 if table in ("part", "datasheet") or table.startswith("made") else 64)  # a part has a few dozen attributes
        rows, met = self._touched(table, old, new, most)
        count = self._once(path, lambda: rows).count()
        replaced = 0 if met is None or not count else met.count()
        if not count:
            return kept
        entries = [*kept, (table, path, count, count - replaced)]
        if sum(e[2] for e in entries[1:]) <= LOOSE * entries[0][2]:
            return entries
        whole = self._table([*before, {"table": table, "path": path, "rows": count}], table)
        count = self._once(f"{path}-whole", lambda: whole).count()
        return [(table, f"{path}-whole", count, count)]
