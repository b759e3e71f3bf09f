"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents becomes weighted term vectors - hashed words, and
the shapes of words and their repetition, which is what sets prose apart from junk -
whose leading singular directions span the latent space. The labelled vectors are sent
to the executors; every document is projected, its cosine with every labelled vector is
computed exactly, in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled import training_rows

#: At most about so many labelled documents of each class are learned from and sent out.
MAX_LABELLED = 3_000
SHAPES, WORDS, COUNTS = 512, 1024, 4
TERMS = SHAPES + WORDS + COUNTS
RANK, NEIGHBOURS, BLOCK = 48, 25, 256
SHARPNESS = 4
#: Words whose slots a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 60_000, 40
THRESHOLD = 0.7
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Capitals as A, other letters as a, digits as 0; runs shortened to two at most."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)


class Terms(dict):
    """word -> shape slot * WORDS + word slot; words of up to ``REMEMBERED_CHARS`` are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        slots = zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES, zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS
        code = slots[0] * WORDS + slots[1]
        if len(word) <= REMEMBERED_CHARS:
            self[word] = code
        return code


def term_vector(text: str, terms: Terms) -> np.ndarray:
    """Term frequencies of a text; shapes and counts are shares of its words, since how much of
    a text is junk matters, words are damped counts."""
    out = np.zeros(TERMS, np.float32)
    words = text.split()
    if words:
        n = len(words)
        codes = np.fromiter(map(terms.__getitem__, words), np.int64, n)
        out[:SHAPES] = np.sqrt(np.bincount(codes // WORDS, minlength=SHAPES) / n)
        out[SHAPES : SHAPES + WORDS] = np.log1p(np.bincount(codes % WORDS, minlength=WORDS))
        out[SHAPES : SHAPES + WORDS] *= 0.3 / np.linalg.norm(out[SHAPES : SHAPES + WORDS])
        same = np.count_nonzero(codes[1:] == codes[:-1]) / n
        out[-COUNTS:] = np.sqrt([same, 1 - len(np.unique(codes)) / n, n < 20, sum(text.count(c) for c in "#*$%&|<>!") / len(text)])
    return out


class Space:
    """Projection onto the leading singular directions of the labelled documents."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        seen = (vectors > 0).mean(0)
        self.idf = (np.log((1 + len(vectors)) / (1 + seen * len(vectors))) * 0.3 + 1).astype(np.float32)
        weighted = vectors * self.idf
        self.centre = weighted.mean(0)
        rank = min(RANK, *weighted.shape)
        _, strength, directions = np.linalg.svd(self._sketch(weighted - self.centre, rank + 16), full_matrices=False)
        self.basis = directions[:rank].T.astype(np.float32)
        self.labels, self.vectors = labels.astype(np.float32), self.project(vectors)

    @staticmethod
    def _sketch(a: np.ndarray, size: int) -> np.ndarray:
        """Few rows that span what most of ``a`` spans: two passes of a randomised range finder."""
        q = np.random.default_rng(7).standard_normal((size, len(a))).astype(np.float32) @ a
        for _ in range(2):
            q = np.linalg.qr(q.T)[0].T
            q = (q @ a.T) @ a
        return np.linalg.qr(q.T)[0].T * np.linalg.norm(a @ np.linalg.qr(q.T)[0], axis=0)[:, None]

    def project(self, vectors: np.ndarray) -> np.ndarray:
        z = (vectors * self.idf - self.centre) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of up to ``BLOCK`` vectors. Blocks are filled up to that, so a vector's products do
        not depend on what stands beside it. Neighbours equally near to six digits are taken in
        the order of the labelled sample: by id, then by vector."""
        block = np.zeros((BLOCK, vectors.shape[1]), np.float32)
        block[: len(vectors)] = vectors
        cosines = (self.project(block) @ self.vectors.T)[: len(vectors)]
        n = cosines.shape[1]
        k = min(NEIGHBOURS, n)
        order = np.rint(cosines * -1e6).astype(np.int64) * n + np.arange(n)  # no two are equal
        near = np.argpartition(order, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def train(docs: DataFrame, labels: DataFrame, training) -> Space | None:
    """None where no labelled document is there to learn from."""
    sample = training_rows(docs, labels, "quality", training, MAX_LABELLED)

    def run(batches):
        terms = Terms()
        for b in common.sliced(batches, "text"):
            vectors = [term_vector(t or "", terms).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array(vectors, pa.binary())], ["doc_id", "label", "vector"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, common.with_fields(sample.select("doc_id", "label").schema, vector="binary")).collect()  # at most about 2 * MAX_LABELLED
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["vector"])))
    return Space(np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """doc_id, score and predicted for every row. A null or empty text is the zero vector and
    gets its neighbours' vote; without any labelled document every score is 0.5. Repeated
    rows get equal scores, ties are broken as ``Space.vote`` says; other columns are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, training))

    def run(batches):
        terms, space = Terms(), sent.value
        for b in common.sliced(batches, "text"):
            texts = b["text"].to_pylist()
            scores = [np.full(0, 0.5)]
            for i in range(0, len(texts), BLOCK):
                block = np.stack([term_vector(t or "", terms) for t in texts[i : i + BLOCK]])
                scores.append(np.full(len(block), 0.5) if space is None else space.vote(block))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(scores).astype(float))], ["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    out = docs.mapInArrow(run, common.with_fields(docs.select("doc_id").schema, score="double"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``, by ``score``.

    Labels of rows whose crc32 of the id is 2 modulo 4 are held out. A null id counts as
    an empty string there.
    """
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = common.id_remainder(F.col("doc_id"), 4) == 2
    return score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
