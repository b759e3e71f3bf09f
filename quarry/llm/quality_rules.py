"""Quality rules by weak supervision.

Each rule votes that a document is good (1), bad (0), or abstains (-). Nobody labels
anything: how often every rule casts each vote on good and on bad documents, and the
share of good documents, are estimated by expectation-maximisation, and a document is
kept if its posterior probability of being good reaches a threshold. Most rules look
for one fault and abstain otherwise, so an abstention is an outcome with its own rate.
The votes of a document form a pattern, and EM needs only how often each pattern
occurs, a table that cannot outgrow 3 ** len(RULES) rows whatever the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "capitals", "exclaiming", "dup_lines", "repeats", "stutter", "word_length", "prose")
THRESHOLD = 0.5
#: Where EM starts: the share of good documents and, for bad and good ones, how often a
#: rule abstains, votes bad and votes good. These counts also stay as a Dirichlet prior.
PRIOR, ROUNDS = 0.75, 100
START = ((16.0, 5.0, 0.5), (17.0, 0.4, 4.0))
_SPACES = " \t\n\r\x0b\x0c"
_CAPITAL = re.compile(r"[A-Z]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    pairs = ids[:-2] * v + ids[1:-1]
    if v >= 2_000_000:  # three ids no longer fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * v + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes."""
    words = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space alone
    n, chars = len(words), len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)

    if not n:
        return 0, 0, symbols, 0, 0, "-" * len(RULES)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = len(_CAPITAL.findall(text))
    mean = chars / n
    stops = text.count(".") + text.count("?")
    faults = (
        symbols / n > 0.1,
        capitals / chars > 0.3,
        text.count("!") / n > 0.1,
        len(lines) > 2 and dups / len(lines) > 0.3,
        repeats / n > 0.4,
        same / n > 0.05,
        not 2 <= mean <= 15,
        sum(map(str.isalpha, text)) / chars < 0.75,
    )
    prose = not faults[-1] and 1 / 100 < stops / n < 1 / 2 and symbols / n < 0.05 and capitals / chars < 0.1
    votes = ["0" if bad else "-" for bad in faults]
    if prose:
        votes[-1] = "1"
    return n, chars, symbols, dups, repeats, "".join(votes)


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def measures(docs: DataFrame) -> DataFrame:
    """Counts and votes of every document; a null text has no words, and rules abstain on it."""

    def run(batches):
        for b in common.sliced(batches, "text"):
            rows = [measure(t or "") for t in b["text"].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [b["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in MEASURES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, MEASURES)


def estimate(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by EM over (pattern, count)."""
    if not patterns:
        return {}
    votes = np.array([["-01".index(c) for c in p] for p, _ in patterns])
    counts = np.array([c for _, c in patterns], float)
    outcome = np.eye(3)[votes]  # pattern x rule x outcome
    start = np.array(START)
    prior, rate = PRIOR, np.tile(start / start.sum(1, keepdims=True), (votes.shape[1], 1, 1))  # rule x class x outcome
    for _ in range(ROUNDS):
        logs = np.einsum("pjo,jco->pc", outcome, np.log(rate)) + np.log([1 - prior, prior])
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = counts[:, None] * np.stack([1 - posterior, posterior], 1)
        rate = np.einsum("pc,pjo->jco", weight, outcome) + start
        rate /= rate.sum(2, keepdims=True)
        prior = float(np.clip((weight[:, 1].sum() + 4) / (counts.sum() + 5), 0.01, 0.99))
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}


def judge(docs: DataFrame) -> DataFrame:
    """Measures of every document with ``posterior``, ``base_failed`` and ``kept``.

    One row per input row, other columns left out. Documents of fewer than 50 words,
    empty and null ones among them, fail outright, as do those with over half their
    words in repeated windows; the rest are kept if the posterior reaches THRESHOLD.
    """
    spark = docs.sparkSession
    found = common.stage_table(measures(docs), "measures")
    patterns = [(r["votes"], r["count"]) for r in found.groupBy("votes").count().orderBy("votes").collect()]  # at most 3 ** len(RULES) rows
    table = spark.createDataFrame(list(estimate(patterns).items()), "votes string, posterior double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return found.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= THRESHOLD))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of every row of ``documents``, repeated rows and null ids included; nulls, empty
    texts and empty tables as it says there."""
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")
