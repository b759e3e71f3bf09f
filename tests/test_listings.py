"""Parts of one key that the source lists apart, against the queries' SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    """Brand#1-7538 and Brand#17-538 differ only in where the number is parted, and their maker is the same."""
    d = tmp_path_factory.mktemp("listed")
    t = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    part = [(7538, "Brand#1", 41), (538, "Brand#17", 36), (7324, "Brand#1", 2), (324, "Brand#17", 9), (36, "Brand#2", 7), (11, "Brand#2", 7)]
    t("part", [(k, "old plate", b, "SMALL", n, 900.0) for k, b, n in part], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    t("nation", [(i, f"NATION_{i}", i % 5) for i in range(7)], "n_nationkey long, n_name string, n_regionkey long")
    t("region", [(i, f"REGION_{i}") for i in range(5)], "r_regionkey long, r_name string")
    return str(d)


@pytest.mark.parametrize("name", ["ingest_second_load", "ingest_store", "part_expand", "ingest_node_counts", "ingest_store_counts"])
def test_listed_parts_are_as_in_sql(spark, listed, name):
    con = duckdb.connect()
    for table in ("part", "nation", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{listed}/{table}.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, listed).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
