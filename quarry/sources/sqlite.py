"""A SQLite catalogue as a batch source: ``spark.read.format("quarry_sqlite")``.

Options: ``path``, a file that every executor can read (a shared mount), ``table``, and
``rows``, how many rows a partition has. Partitions are ranges of ``rowid`` bounded by quantiles of
the rows that pass the tests of ``scan``, so holes make no empty ones; each is read by its
own read-only connection a thousand rows at a time. The file stays one file: what it can
deliver is bounded by the mount, so large catalogues should be dumped to Parquet once.
"""

from __future__ import annotations

import json
import operator
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FETCH = 1_000
_KINDS = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
SIGNS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": None, "null": None, "not null": None}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int, high: int | None):
        self.low, self.high = low, high


def _test(kinds: dict[str, str], column: str, sign: str, value=None) -> tuple[str, list] | None:
    """SQL for a comparison that SQLite may skip rows by, or None where its own comparison could skip
    rows that pass in Spark: columns without a declared type, texts in order, and no numbers."""
    kind, name = kinds.get(column), _name(column)
    if kind is None:
        return None
    if sign in ("null", "not null"):
        return f"{name} IS {sign.upper()}", []
    values = list(value) if sign == "in" else [value]
    fits = (str,) if kind == "string" else (int, float) if kind in ("bigint", "double") else ()
    if not values or any(not isinstance(v, fits) or isinstance(v, bool) or v != v for v in values) or (kind == "string" and sign not in ("=", "in")):
        return None
    return (f"{name} IN ({', '.join('?' * len(values))})" if sign == "in" else f"{name} {sign} ?"), values


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, columns: list[str], kinds: dict[str, str], tests: list = ()):
        self.path, self.table, self.rows, self.columns = path, table, rows, columns
        self.tests = [t for t in (_test(kinds, *x) for x in tests) if t is not None]

    def _where(self, *more: str) -> tuple[str, list]:
        tests = [*[t for t, _ in self.tests], *more]
        return f" WHERE {' AND '.join(tests)}" if tests else "", [v for _, values in self.tests for v in values]

    def partitions(self) -> list[Range]:
        """Ranges of row ids with ``rows`` rows each of those that pass, however the ids are spread; SQLite
        numbers the rows in one walk along its own order, and one id a range comes back."""
        where, values = self._where()
        db = _open(self.path)
        try:
            starts = [r for (r,) in db.execute(f"SELECT id FROM (SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS n FROM {_name(self.table)}{where}) WHERE n % ? = 1 OR ? = 1 ORDER BY id", [*values, self.rows, self.rows])]
        finally:
            db.close()
        return [Range(low, high) for low, high in zip(starts, [*starts[1:], None], strict=False)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # no row passes
            return
        where, values = self._where("rowid >= ?", *(["rowid < ?"] if part.high is not None else []))
        db = _open(self.path)
        try:
            names = ", ".join(map(_name, self.columns)) or "NULL"
            cursor = db.execute(f"SELECT {names} FROM {_name(self.table)}{where}", [*values, part.low, *([part.high] if part.high is not None else [])])
            while some := cursor.fetchmany(FETCH):
                yield from some
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_sqlite"

    def _columns(self) -> list[tuple[str, str, bool]]:
        """(name, type, whether it was declared) of the table's columns."""
        db = _open(self.options["path"])
        try:
            found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return [(c[1], next((t for k, t in _KINDS.items() if k in (c[2] or "").upper()), "string"), bool(c[2])) for c in found]

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind, _ in self._columns())

    def reader(self, schema) -> SqliteReader:
        kinds = {name: kind for name, kind, declared in self._columns() if declared}
        return SqliteReader(self.options["path"], self.options["table"], max(1, int(self.options.get("rows", 50_000))), [f.name for f in schema.fields], kinds, json.loads(self.options.get("tests", "[]")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def scan(spark: SparkSession, path: str, table: str, *tests: tuple, rows: int = 50_000) -> DataFrame:
    """Rows of a table that pass all ``tests``: (column, sign, value) with =, <, <=, >, >= or in, and
    (column, "null") or (column, "not null").

    SQLite skips rows by those that it compares as Spark does, before a row reaches Python, and
    ranges are cut among the rows left; Spark applies all tests to what comes. They are an
    option of the frame, as Spark keeps a Python source's reader, together with filters
    pushed into it by one query, for the frame's next query.
    """
    for column, sign, *value in tests:
        if sign not in SIGNS or len(value) != (0 if "null" in sign else 1):
            raise ValueError(f"no test {sign} of {column}")
    register(spark)
    out = spark.read.format("quarry_sqlite").option("path", path).option("table", table).option("rows", rows).option("tests", json.dumps(tests)).load()
    for column, sign, *value in tests:
        c = F.col(f"`{column}`")
        out = out.where(c.isNull() if sign == "null" else c.isNotNull() if sign == "not null" else c.isin(*value[0]) if sign == "in" else SIGNS[sign](c, value[0]))
    return out
