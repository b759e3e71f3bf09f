"""BPE encoding and decoding through a distinct-word table.

Byte-level BPE never merges across the words of its pre-tokenizer, so a word always
has the same ids. The table is dealt into as many chunks of whole documents as there
are shuffle partitions. Each chunk lists its distinct words; the lists are dealt by
word, so that each word meets its equals in one place and is encoded once, and the
encoded words go back to their chunks. There a document's words, in order, look up
their ids. Decoding joins ids with the vocabulary's pieces and strings the pieces
together. Documents and word lists travel as compressed Arrow streams.

What is held in one place is a chunk's documents and words, or one bucket's share of
the distinct words, and the vocabulary, whose size is fixed by its file: more shuffle
partitions make all of them smaller.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Words that are given to the tokenizer at once.
ENCODED = 1_000
#: Rows, and bytes, that are gathered before they are dealt into chunks: small lots pack badly.
GATHERED, GATHERED_BYTES = 10_000, 16 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 letters
    for themselves, the other bytes in turn from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What the file of a byte-level tokenizer says; ``text`` is the file's content."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
        self.added = [t["content"] for t in spec["added_tokens"]]
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i) for i in range(max(pieces) + 1)]

    def splitter(self):
        """Text -> words. Added tokens are words of their own, wherever they stand."""
        return splitter(self.added)


def splitter(added: list[str]):
    word = regex.compile(public_tokenizers.PATTERN)
    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def split(text: str) -> list[str]:
        if marks is None or not marks.search(text):
            return word.findall(text)
        return [w for i, part in enumerate(marks.split(text)) for w in ([part] if i % 2 else word.findall(part))]

    return split


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False, text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int); a null or empty text has no ids. With
    ``decoded``, ``decode`` follows in the same tasks; without ``text`` that column is left out.

    Every row is kept, repeated ones too, with all its columns; a column named ids is
    replaced. An empty table gives an empty table.
    """
    spark, n = docs.sparkSession, common.partitions(docs.sparkSession)
    docs = docs.drop("ids", *(["decoded"] if decoded else []))
    own, added, content = docs.columns, vocabulary.added, spark.sparkContext.broadcast(vocabulary.text)
    out = own if text else [c for c in own if c != "text"]
    schema = common.with_fields(docs.select(*out).schema, ids="array<int>", **({"decoded": "string"} if decoded else {}))
    pieces = spark.sparkContext.broadcast(vocabulary.pieces) if decoded else None
    chunk = _unused(own, "__chunk")
    labels = common.even_labels(spark, n)
    key = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in own]), F.lit(n)).cast("int")
    packed = docs.withColumn(chunk, F.element_at(F.array(*map(F.lit, labels)), key + 1)).mapInArrow(pack_rows(chunk, own), "chunk int, rows binary").repartition(n, "chunk")

    words = packed.mapInArrow(distinct_words(added, labels), "chunk int, bucket int, rows binary").repartition(n, "bucket")
    encoded = words.mapInArrow(encode_words(content), "chunk int, words binary")
    return packed.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(look_up(out, added, pieces), schema)


def pack_rows(chunk: str, own: list[str]):
    def deal(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.concat_batches(held)
        held.clear()
        labels = b[chunk].to_numpy()
        order, b = np.argsort(labels, kind="stable"), b.select(own)
        labels = labels[order]
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        blobs = [common.pack(b.take(pa.array(order[i:j]))) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(labels[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "rows"])

    def run(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= GATHERED or size >= GATHERED_BYTES:
                yield deal(held)
                rows = size = 0
        if held:
            yield deal(held)
        common.trim()

    return run


def distinct_words(added: list[str], labels: list[int]):
    """Each chunk's distinct words, as a list per bucket of words."""

    def run(batches):
        split, found = splitter(added), {}
        for b in batches:
            for c, rows in zip(b["chunk"].to_pylist(), b["rows"].to_pylist(), strict=True):
                words = found.setdefault(c, set())
                for part in common.sliced(common.unpack(rows).to_batches(), "text"):
                    for text in part["text"].to_pylist():
                        words.update(split(text or ""))
        for c, words in found.items():
            lists: dict[int, list] = {}
            for w in words:
                lists.setdefault(zlib.crc32(w.encode()) % len(labels), []).append(w)
            for k, some in lists.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([labels[k]], pa.int32()), pa.array([common.pack(pa.table({"word": sorted(some)}))], pa.binary())], ["chunk", "bucket", "rows"])

    return run


def encode_words(content):
    """A bucket's distinct words, each encoded once, as (word, ids) lists for the chunks that asked.
    Words and ids are held as Arrow arrays, which take a fraction of what Python's objects would."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        common.trim()  # what reading the vocabulary took

        def encoded(words: pa.Array) -> pa.Array:
            parts, lengths = [np.zeros(0, np.int32)], [0]
            for i in range(0, len(words), ENCODED):
                found = [e.ids for e in tokenizer.encode_batch(words[i : i + ENCODED].to_pylist(), add_special_tokens=False)]
                lengths += map(len, found)
                parts.append(np.fromiter((x for ids in found for x in ids), np.int32))
            return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(parts)))

        known, ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        for b in batches:
            lists = [common.unpack(rows)["word"].combine_chunks() for rows in b["rows"].to_pylist()]
            if not lists:
                continue
            words = pa.concat_arrays(lists).dictionary_encode()
            new = words.dictionary.filter(pc.invert(pc.is_in(words.dictionary, value_set=known)))
            known, ids = pa.concat_arrays([known, new]), pa.concat_arrays([ids, encoded(new)])
            at, begin = pc.index_in(words.dictionary, value_set=known).take(words.indices), 0
            for c, some in zip(b["chunk"].to_pylist(), lists, strict=True):
                blob = common.pack(pa.table({"word": some, "ids": ids.take(at.slice(begin, len(some)))}))
                begin += len(some)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "words"])
        del tokenizer, encoded, known, ids
        common.trim()

    return run


def look_up(own: list[str], added: list[str], pieces=None):
    """Join a chunk's documents, word by word in order, with the ids of its words, and the ids
    with their pieces if those are given."""
    held: list[pa.Array] = []  # the piece table, made once a task

    def run(packed: pa.Table, encoded: pa.Table) -> pa.Table:
        split = splitter(added)
        table = pa.concat_tables([common.unpack(x) for x in encoded["words"].to_pylist()]) if len(encoded) else pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
        known, ids = table["word"].combine_chunks(), table["ids"].combine_chunks()
        del table
        lengths = pc.list_value_length(ids).to_numpy().astype(np.int64)
        values, starts = ids.flatten().to_numpy(), np.cumsum(lengths) - lengths
        if pieces is not None and not held:
            held.append(piece_table(pieces.value))

        def places(words: list[str]) -> np.ndarray:
            """Where each word is in the chunk's list, by a hash table of these words, which is the smaller one."""
            words = pa.array(words, pa.string()).dictionary_encode()
            found = pc.index_in(known, value_set=words.dictionary).fill_null(-1).to_numpy()
            at = np.zeros(len(words.dictionary), np.int64)
            at[found[found >= 0]] = np.flatnonzero(found >= 0)
            return at[words.indices.to_numpy()]

        done = []
        for rows in packed["rows"].to_pylist():
            for texts in common.sliced(common.unpack(rows).to_batches(), "text"):
                words, ends = [], [0]
                for text in texts["text"].to_pylist():
                    words += split(text or "")
                    ends.append(len(words))
                at = places(words)
                each = lengths[at]
                before = np.concatenate([[0], np.cumsum(each)])
                found = values[np.arange(before[-1]) + np.repeat(starts[at] - before[:-1], each)]
                made = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(found, pa.int32()))
                columns = [*(texts[c] for c in own), made, *([join_pieces(made, held[0])] if pieces is not None else [])]
                done.append(pa.RecordBatch.from_arrays(columns, [*own, "ids", *(["decoded"] if pieces is not None else [])]))
        del known, ids, lengths, values, starts, places
        common.trim()
        return pa.Table.from_batches(done)

    return run


def piece_table(pieces: list[bytes | None]) -> pa.Array:
    """Pieces by id; one more, empty, for ids outside the vocabulary."""
    return pa.array([p or b"" for p in pieces] + [b""], pa.binary())


def join_pieces(lists: pa.Array, table: pa.Array) -> pa.Array:
    """Texts of lists of ids: every id is joined with its piece, a list's pieces put together."""
    lists = lists.fill_null([]) if lists.null_count else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(table) - 1), flat, len(table) - 1).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(pa.array(flat))), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null ids give an empty text.

    The ids of a batch are joined with the vocabulary's pieces, sent to the executors;
    bytes that are not UTF-8 become U+FFFD, ids outside the vocabulary nothing. A
    column named decoded is replaced.
    """
    rows = rows.drop("decoded")
    own, pieces = rows.columns, rows.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def run(batches):
        table = piece_table(pieces.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in own), join_pieces(b["ids"], table)], [*own, "decoded"])

    return rows.mapInArrow(run, common.with_fields(rows.schema, decoded="string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for every row, repeated ones too.
    A null or empty text has no tokens; other columns are left out."""
    vocabulary = Vocabulary(path or public_tokenizers.path(VOCABULARY))
    both = encode(docs.select("doc_id", "text"), vocabulary, decoded=True, text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
