"""What BPE's tasks hold at once, and the size of the batches that the pipeline sends to Python."""

import itertools
import tracemalloc
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe_codec, common


def test_small_lots_are_packed_together():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [*range(i, i + 100)], "c": pa.array([3, 4] * 50, pa.int32())}) for i in range(0, 1000, 100)]
    out = list(bpe_codec.pack_rows("c", ["doc_id"])(iter(batches)))
    assert [b["chunk"].to_pylist() for b in out] == [[3, 4]]
    assert [common.unpack(x)["doc_id"].to_pylist() for x in out[0]["rows"].to_pylist()] == [[*range(0, 1000, 2)], [*range(1, 1000, 2)]]
    assert list(bpe_codec.pack_rows("c", ["doc_id"])(iter([batches[0].slice(0, 0)]))) == []


def test_look_up_holds_no_python_object_for_each_word():
    words = [" " + "".join(w) for w in itertools.product("abcdefghijklmnopqr", repeat=4)]
    encoded = pa.table({"words": [common.pack(pa.table({"word": words, "ids": pa.array([[i, 7] for i in range(len(words))], pa.list_(pa.int32()))}))]})
    packed = pa.table({"rows": [common.pack(pa.table({"doc_id": [1, 2, 3], "text": [words[5] + words[99_999] + words[5], None, words[0]]}))]})
    look_up = bpe_codec.look_up(["doc_id"], [])
    tracemalloc.start()
    got = look_up(packed, encoded)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pydict() == {"doc_id": [1, 2, 3], "ids": [[5, 7, 99_999, 7, 5, 7], [], [0, 7]]}
    assert peak < 8 << 20


def test_words_of_later_batches_are_known():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lists = [["one", " two", "thrée"], [" two", "four"], ["four", "one", " five"]]
    batches = [pa.RecordBatch.from_pydict({"chunk": pa.array(c, pa.int32()), "rows": [common.pack(pa.table({"word": lists[i]})) for i in c]}) for c in ([0, 1], [2])]
    empty = batches[0].slice(0, 0)
    with open(path, encoding="utf-8") as f:
        out = list(bpe_codec.encode_words(SimpleNamespace(value=f.read()))(iter([empty, *batches])))
    lib = Tokenizer.from_file(path)
    assert [b["chunk"].to_pylist() for b in out] == [[0], [1], [2]]
    for b, words in zip(out, lists, strict=True):
        assert common.unpack(b["words"][0].as_py()).to_pydict() == {"word": words, "ids": [lib.encode(w, add_special_tokens=False).ids for w in words]}


@pytest.mark.parametrize("rows", [10_000, 0, 100])
def test_stages_send_small_batches(spark, rows):
    key, was = corpus_pipeline.BATCH, spark.conf.get(corpus_pipeline.BATCH)
    try:
        spark.conf.set(key, rows)
        docs = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs)(spark, spark.range(3000).coalesce(1), "")
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
        assert max(r["n"] for r in sizes) == min(rows or 500, 500) and sum(r["n"] for r in sizes) == 3000
    finally:
        spark.conf.set(key, was)
