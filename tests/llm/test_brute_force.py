"""Operators that SQL cannot express, against slow and plain versions of what they compute."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import lm_scoring, quality_classifier, quality_rules, simhash

SPACE = " \t\n\r\x0b\x0c"
AWKWARD = [None, "", " \n\t", "one", "Two words", "ß İ x ẞ", "tie tie", "a\nb\na\n \nb\na", "#*$%&|<>" * 3, "x " * 500, "a b c a b c d"]


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c not in SPACE:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def made(n=60, seed=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["#tag", "A|B", "<x>", "50%", "É", "Über"]
    lines = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 15)))
    return AWKWARD + [lines() for _ in range(n)]


def test_rule_columns(spark):
    texts = made()
    out = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    posterior = quality_rules.estimate(sorted(Counter(r["votes"] for r in out).items()))
    for r in out:
        text, words, seen, dups = texts[r["doc_id"]] or "", split(texts[r["doc_id"]]), set(), 0
        for line in text.split("\n"):
            dups += bool(split(line)) and line in seen
            seen.add(line)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeats = sum(any(0 <= k <= len(words) - 3 and windows[tuple(words[k : k + 3])] > 1 for k in (i - 2, i - 1, i)) for i in range(len(words)))
        want = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, repeats
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        assert r["base_failed"] == failed and r["posterior"] == pytest.approx(posterior[r["votes"]])
        assert r["kept"] == (not failed and posterior[r["votes"]] >= quality_rules.THRESHOLD)


def test_fingerprint_bits(spark):
    texts = made(seed=9)
    out = {r["doc_id"]: r["fp"] for r in simhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert out[i] & (2**64 - 1) == want


def test_votes(spark):
    rng = np.random.default_rng(6)
    labelled = rng.random((120, quality_classifier.TERMS)).astype(np.float32)
    labelled[60:] *= rng.random(quality_classifier.TERMS).astype(np.float32)
    labelled[5] = labelled[4] = labelled[3]  # ties
    labels = (np.arange(120) >= 60).astype(int)
    space = quality_classifier.Space(labelled, labels)
    asked = np.concatenate([labelled[:20], labelled[60:80], rng.random((30, quality_classifier.TERMS)), np.zeros((1, quality_classifier.TERMS))]).astype(np.float32)
    for vector, got in zip(asked, space.vote(asked), strict=True):
        a = space.project(vector[None])[0].astype(float)
        cosines = [float(a @ b.astype(float)) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12) for b in space.vectors]
        near = sorted(range(120), key=lambda i: (-round(cosines[i], 6), i))[: quality_classifier.NEIGHBOURS]
        weights = [max(cosines[i], 1e-6) ** quality_classifier.SHARPNESS for i in near]
        assert got == pytest.approx(sum(w * labels[i] for w, i in zip(weights, near, strict=True)) / sum(weights), abs=1e-3)
    alone = np.array([space.vote(v[None])[0] for v in asked])
    assert np.array_equal(alone, space.vote(asked))  # a score does not depend on what stands beside it


def slow_log10(model, ids):
    """Log10 likelihood of one document, a step at a time in double precision."""
    p, size = {k: v.astype(float) for k, v in model.p.items()}, lm_scoring.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    h, total, heads = np.zeros(size), 0.0, lm_scoring.HEAD // lm_scoring.PER_CLASS
    for x, y in zip([lm_scoring.END, *ids], [*ids, lm_scoring.END], strict=True):
        gate = p["x"][x]
        z, r = np.split(sigmoid(gate[: 2 * size] + h @ p["u"]), 2)
        h = (1 - z) * h + z * np.tanh(gate[2 * size :] + (r * h) @ p["uc"])
        classes = softmax(h @ p["wc"] + p["bc"])
        if y < lm_scoring.HEAD:
            k = y // lm_scoring.PER_CLASS
            total += math.log10(classes[k]) + math.log10(softmax(h @ p["ww"][k] + p["bw"][k])[y % lm_scoring.PER_CLASS])
        else:
            total += math.log10(classes[heads + y - lm_scoring.HEAD])
    return total


def test_model_against_single_steps():
    rng = np.random.default_rng(3)
    model = lm_scoring.Gru(rng.normal(0, 0.4, lm_scoring.Gru.SIZE))
    docs = [rng.integers(0, lm_scoring.END, n).astype(np.int16) for n in (0, 1, 15, 16, 17, 40, 333)]  # around a window's length
    got = model.walk(docs, False)
    assert got == pytest.approx([slow_log10(model, d.tolist()) for d in docs], rel=1e-4)
    assert model.walk(docs[::-1], False) == pytest.approx(got[::-1], rel=1e-4)


def test_score_against_single_steps(spark, monkeypatch):
    """The whole score: the model's part and each word's share of its bin, by plain counts."""
    held = {}
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: held.setdefault("model", train(*a)))
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"] + [f"rare{i}" for i in range(1200)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([30, 180, len(words)])]) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(120, "never seen Words é"), (121, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("doc_id") < 100).collect()}
    counts = Counter(w for i, t in rows if i < 100 for w in lm_scoring.tokens(t))
    head = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].decode()))[: lm_scoring.HEAD]]
    place, mass = {w: i for i, w in enumerate(head)}, defaultdict(lambda: 0.5)
    for w, n in counts.items():
        if w not in place:
            mass[lm_scoring.tail_bin(w)] += n + 0.5
    assert len(counts) > lm_scoring.HEAD
    for i, text in rows:
        found = lm_scoring.tokens(text)
        ids = [place.get(w, lm_scoring.HEAD + lm_scoring.tail_bin(w)) for w in found]
        share = sum(math.log10((counts[w] + 0.5) / mass[lm_scoring.tail_bin(w)]) for w in found if w not in place)
        assert out[i]["score"] == pytest.approx(slow_log10(held["model"], ids) + share, rel=1e-3, abs=1e-3)
