"""The pipeline and the queries over awkward rows: nulls, blanks, repeats, clashing columns, no rows."""

import pytest

import corpus_pipeline
from quarry.llm import registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, size string, ids string, score string, copies string, block string, `at` string, drop string, tk string, fp string, learn string"
EXTRA = ("s", "i", "sc", "c", "b", "a", "d", "t", "f", "l")


def write(spark, folder, texts):
    rows = [(i, t, "en", s, None, *EXTRA) for i, t, s in texts]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i, _, _ in texts if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


LONG = " ".join(f"word{i % 700}" for i in range(9000))
PROSE = "the river ran past the old mill and the people of the town came down to see it in the evening"
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, f"{PROSE}\na second line of this text", "a"),
    (6, f"{PROSE}\na second line of this text", "b"), (7, f"{PROSE}\nanother line that nobody else has at all", None), (7, "an id that occurs twice, here with other words", "a"),
    (None, f"{PROSE}\na line of a row without an id", "a"), (None, None, None), (5, f"{PROSE}\na second line of this text", "a"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("rows"), ROWS)


def test_stages_keep_columns_and_clean_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    lines = corpus_pipeline.dedup_lines(spark, kept, folder)
    got = sorted((r["doc_id"] or 99, r["text"]) for r in lines.collect())
    assert lines.columns == docs.columns and len(got) == len(ROWS)
    assert [t for i, t in got if i == 6] == [""] and (99, "a line of a row without an id") in got
    assert sum(PROSE in t for _, t in got) == 2  # both rows of document 5
    near = corpus_pipeline.drop_near(spark, docs, folder)
    assert sorted(r["doc_id"] or 99 for r in near.collect()) == [1, 4, 5, 5, 7, 7, 99, 99]
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.where("doc_id = 4").count() <= 2


def test_run(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", [])).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_keep_every_row(spark, folder, name):
    got = registry.QUERIES[name](spark, folder)
    want = {"op9_chat": 1, "op11_prefix_trie": 0, "op12_ann": 0, "op13_whitening": 0}.get(name, len(ROWS))  # no conversation but the one that a query adds
    assert got.count() == want


def test_stages_leave_no_tables_behind(spark, folder):
    """When a stage is called, what the one before it staged goes, unless it is still to be read."""
    from quarry.llm import common

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    first = stages["line dedup"](spark, docs, folder)
    held = list(corpus_pipeline._HELD)
    assert held and first.count() == len(ROWS)
    lazy = stages["mixing"](spark, first, folder)  # ``first`` was not written
    assert lazy.columns == docs.columns and first.count() == len(ROWS)
    kept = common.stage_table(first, "kept")
    stages["line dedup"](spark, docs, folder).count()
    gone = list(corpus_pipeline._HELD)
    stages["toxicity"](spark, kept, folder).count()
    exists = lambda p: spark._jvm.java.io.File(p.removeprefix("file:")).exists()
    assert gone and not any(map(exists, gone))
