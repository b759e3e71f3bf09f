"""Stems: forms of a word meet, words that are not forms of it do not."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import exprs
from quarry.operators import search

STEMS = {
    "resistors": "resistor", "resistor": "resistor", "switches": "switche", "switching": "switch", "switched": "switch", "batteries": "batteri", "battery": "batteri", "ties": "tie", "gas": "gas", "bus": "bus", "glass": "glass",
    "glasses": "glass", "agreed": "agree", "feed": "feed", "feeding": "feed", "mounting": "mount", "mounted": "mount", "plating": "plate", "plated": "plate", "sizing": "size", "hopping": "hop", "hoping": "hope", "fitted": "fit",
    "ring": "ring", "spring": "spring", "string": "string", "red": "red", "toy": "toy", "by": "by", "is": "is", "10k": "10k", "näms": "näms", "coupled": "coupl", "filing": "file", "boxing": "box", "relays": "relay", "relay": "relay", "supplies": "suppli", "supply": "suppli", "sky": "ski",
}


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS] + [(None,), ("",)], "w string")
    got = {r["w"]: r["s"] for r in words.select("w", exprs.stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in STEMS} == STEMS and got[None] is None and got[""] == ""


@pytest.mark.parametrize(("asked", "found"), [("mounting", {"a", "b"}), ("mounts the", {"a", "b"}), ("batteries", {"c"}), ("springs", {"d"}), ("sprung ring", set()), ("the", set()), (None, set())])
def test_forms_find_each_other(spark, asked, found):
    parts = spark.createDataFrame([("a", "surface mount resistor"), ("b", "Mounted, plated"), ("c", "battery holder"), ("d", "a spring"), ("e", None)], "xid string, description string")
    q = spark.createDataFrame([(1, asked)], "query_id int, raw_query string")
    assert {r["xid"] for r in search.full_text(q, parts).collect()} == found
