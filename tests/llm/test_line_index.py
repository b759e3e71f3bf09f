"""The line index against brute force, over insertions, deletions, hot lines and full filters."""

import hashlib
import random

from quarry.llm import line_dedup


def want(rows):
    """Dropped key digests of each document."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line_dedup.line_key(line)
            if k:
                holders.setdefault(k, set()).add(i)
    lost = {}
    for k, ids in holders.items():
        for i in ids - {min(ids)}:
            lost.setdefault(i, set()).add(k)
    return lost


def got(index):
    return {r["doc_id"]: {bytes(k) for k in r["keys"]} for r in index.drops().collect()}


def test_changes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "PART", 50)  # many shards, and the hot line's is dealt in parts
    rng = random.Random(5)
    line = lambda: f"a line that may repeat {rng.randrange(150)}"
    rows = [(i, "\n".join(["the same line everywhere", *(line() for _ in range(4)), f"own line number {i}"])) for i in range(200)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    first = line_dedup.LineIndex.build(frame(rows[:120]))
    assert first.shards > 2 and got(first) == want(rows[:120])
    second = first.insert(frame(rows[100:]))  # ids 100 to 119 are known and left out
    assert got(second) == want(rows)
    refs = {bytes(r["key"]): r["refs"] for r in second.counts.collect()}
    assert refs[line_dedup.line_key("the same line everywhere")] == 200
    gone = [(i,) for i in (0, 3, 7, 50, 199, 777)]
    third = second.delete(spark.createDataFrame(gone, "doc_id long"))
    assert got(third) == want([r for r in rows if (r[0],) not in gone])
    assert got(third.compact()) == got(third)
    assert got(third.delete(frame(rows).select("doc_id"))) == {}


def test_full_filters_grow(spark):
    rows = [(i, f"shared line number {i // 2}") for i in range(40)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    small = line_dedup.LineIndex.build(frame(rows))
    more = [(100 + i, f"later line number {i // 2}") for i in range(1200)]
    grown = small.insert(frame(more))
    size = lambda index: max(line_dedup.Cuckoo.load(bytes(r["filter"])).table.size for r in index.filters.collect())
    assert size(grown) > size(small) and got(grown) == want(rows + more)


def test_filter_lets_no_shared_key_slip():
    filt, keys = line_dedup.Cuckoo(8), [hashlib.md5(b"%d" % i).digest() for i in range(500)]
    filt.insert(keys)
    assert filt.full() and filt.contains(keys).all()


def test_insert_is_build_with_null_ids_and_from_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 15)
    rng = random.Random(8)
    text = lambda: "\n".join(f"a line that may repeat {rng.randrange(90)}" for _ in range(3))
    rows = [(i if rng.random() < 0.7 else None, text()) for i in range(90)] + [(None, None), (None, text()), (None, "a line of rows without an id"), (500, "a line of rows without an id")]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    lost = lambda index: sorted((r["doc_id"], r["tk"], [bytes(k) for k in r["keys"]]) for r in index.drops().collect())
    whole = line_dedup.LineIndex.build(frame(rows))
    for cut in (0, 40):
        index = line_dedup.LineIndex.build(frame(rows[:cut])).insert(frame(rows[cut:70])).insert(frame(rows[70:]))
        assert lost(index) == lost(whole) and index.shards > 1  # an index begun empty splits its one shard
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, whole.counts.collect()))
        assert lost(index.delete(frame([(None, "")]).select("doc_id"))) == lost(line_dedup.LineIndex.build(frame([r for r in rows if r[0] is not None])))
