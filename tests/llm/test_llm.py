"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe_codec, chat_format, components, fingerprints, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, simhash, toxicity

BASE = "doc_id long, text string, source string, size string, ids string, n_lines string, score string"
TEXTS = [
    None, "", "   \n\t", "one two three four five six seven eight nine ten\nA shared line here\nunique line of doc three",
    "a SHARED line here  \nother words\nother words", "word " * 300, "naïve <|endoftext|> café's 123  \u00a0x\n\n!!?", "\U0001f600 emoji ffi ß",
    "one two three four five six seven eight nine ten\nA shared line here\nunique line of doc three", "long " + " ".join(f"w{i}" for i in range(5000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["b", None, "a"][i % 3], "x", "y", "z", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "a shared line here", None, "x", "y", "z", "s")], BASE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], BASE)


def test_mixing(docs, empty, spark):
    out = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(out) == len(TEXTS) + 2 and all(r["size"] == size(r["text"]) and r["taken"] <= 2 * r["size"] for r in out)
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    left, targets, free = 1.5 * sum(sizes.values()), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while free:  # share by weight, cap, share the excess again
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > 2 * sizes[s] + 1e-9]
        for s in over or list(free):
            targets[s] = 2 * sizes[s] if over else free[s] * level
            left -= targets[s] if over else 0
            del free[s]
        if not over:
            break
    assert {r["source"]: pytest.approx(r["target"]) for r in out} == targets
    assert mixing.emit(docs).columns == docs.columns and mixing.emit(docs).count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0


def test_line_dedup(docs, empty, spark):
    rows = docs.collect()
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    ident = lambda r: math.inf if r["doc_id"] is None else r["doc_id"]
    holders = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            holders.setdefault(key(x), set()).add(ident(r))
    want = sorted(("\n".join(x for x in (r["text"] or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == ident(r)) for r in rows))
    got = line_dedup.dedup(docs).collect()
    assert sorted(r["text"] for r in got) == want and line_dedup.dedup(empty).count() == 0


def test_line_index_is_reversible(docs):
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    first = line_dedup.LineIndex.build(docs.where("doc_id < 8"))
    there = first.insert(docs.where("doc_id >= 8"))
    back = there.delete(docs.where("doc_id >= 8").select("doc_id"))
    state = lambda i: (sorted(map(tuple, i.counts.collect())), {s["shard"]: np.sort(line_dedup.Cuckoo.load(bytes(s["filter"])).table.ravel()).tolist() for s in i.filters.collect()})
    assert state(back) == state(first) and state(there) != state(first)
    assert sorted(map(str, there.drops().collect())) == sorted(map(str, line_dedup.LineIndex.build(docs).drops().collect()))


def test_cuckoo():
    keys = [hashlib.md5(b"%d" % i).digest() for i in range(20_000)]
    filt = line_dedup.Cuckoo(10_000)  # half the room that is needed
    filt.insert(keys)
    assert filt.contains(keys).all()
    filt.delete(keys[:10_000])
    assert line_dedup.Cuckoo.load(filt.dump()).contains(keys[10_000:]).all()


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, vocabulary = Tokenizer.from_file(path), bpe_codec.Vocabulary(path)
    out = bpe_codec.decode(bpe_codec.encode(docs, vocabulary), vocabulary).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, lib.decode(ids, skip_special_tokens=False))
    assert bpe_codec.encode(empty, vocabulary).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_split_keeps_ids(text):
    lib = test_split_keeps_ids.__dict__.setdefault("lib", __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    ids = [i for w in bpe_codec.splitter(["<|endoftext|>"])(text) for i in lib.encode(w, add_special_tokens=False).ids]
    assert ids == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\\#</|:turn> \n", max_size=12), st.text(alphabet="\\#</turn>|: \nx", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    back, want = chat_format.ReadBack(1), hashlib.sha256()
    for role, text in turns:
        seg, a, b, _ = chat_format.flatten_turn(role, [{"kind": "text", "text": text}])
        back.feed(seg, a, b)
        want.update(f"{role}\n{text}\n".encode())
    assert back.row()[1:3] == (len(turns), want.hexdigest())


def test_chat_parts():
    parts = [{"kind": "text", "text": "see <|image:0|> "}, {"kind": "image", "ref": "a.png", "width": 56, "height": 29}, {"kind": "audio", "seconds": 2.0}, {"kind": "document", "pages": 2}, {"kind": "odd"}]
    seg, a, b, found = chat_format.flatten_turn("assistant", parts)
    assert seg[a:b] == "see <\\|image:0|> <|image:0|><|audio:1|><|document:2|><|odd:3|>"
    assert [(x["kind"], x["tokens"]) for x in found] == [("image", 4), ("audio", 50), ("document", 1152), ("odd", 1)]
    assert all(seg[x["at"] :].startswith(f"<|{x['kind']}") for x in found)


def test_quality_rules(docs, empty):
    for r in quality_rules.judge(docs).collect():
        if r["doc_id"] is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]] or "")
            windows = Counter(zip(words, words[1:], words[2:], strict=False))
            covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
            assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.judge(empty).count() == 0
    posterior = quality_rules.estimate([("-------1", 900), ("0-------", 60), ("-0------", 40)])
    assert posterior["-------1"] > 0.9 and posterior["0-------"] < 0.5


def test_simhash_links_near_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(16), 2)]  # a bucket over the bound
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:30]]
    fps = sorted({simhash._signed(f) for f in fps})
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    group = {f: f for f in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                group[a] = group[b] = min(group[a], group[b])
        if all(group[group[f]] == group[f] for f in fps):
            break
    assert {r["node"]: r["component"] for r in got} == {f: g for f, g in group.items() if list(group.values()).count(g) > 1}


def test_simhash_rows(docs, empty):
    out = {r["doc_id"]: r for r in simhash.classes(docs).collect()}
    assert out[0]["fp"] == out[1]["fp"] == out[2]["fp"] == 0 and out[2]["component_id"] == 0 and out[8]["component_id"] == 3
    assert simhash.classes(empty).count() == 0 and simhash.keep_first(docs).columns == docs.columns


def test_fingerprints(spark, empty):
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(rng.randrange(60, 300)))) for i in range(30)]
    got = fingerprints.compare(spark.createDataFrame([*rows, rows[0], (None, "x"), (400, None)], "doc_id long, text string")).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(got) == 33 and out.pop(None)["edited"] == "x"  # every row has one, those without ids and repeated ones too
    rows.append((400, ""))
    assert len(out) == 31
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        assert out[i]["edited"] == t[: len(t) - q] + u[:q] and out[i]["n_chars"] == len(t)
    assert fingerprints.compare(empty.select("doc_id", "text")).count() == 0


def test_lm(spark, empty):
    rng = random.Random(2)
    words = {k: [f"{k}{i}" for i in range(30)] for k in "ab"}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(40)) if i else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.where(~held)).collect()}
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").split() + ["END"])
    n, bottom = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for i, t in rows:
        tokens = (t or "").split() + ["END"]
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / bottom) for w in tokens)) and out[i]["train_tokens"] == n
    later = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(out[i]["score"] for i in later) > sum(out[i]["base_score"] for i in later)
    assert lm_scoring.score(empty, docs).count() == 0 and lm_scoring.score(docs.limit(3), empty).count() == 3


def test_gru_gradient():
    rng = np.random.default_rng(0)
    model = lm_scoring.Gru(rng.normal(0, 0.3, lm_scoring.Gru.SIZE))
    x, y, start, _, alive = lm_scoring.lanes([rng.integers(0, lm_scoring.END, n).astype(np.int32) for n in (5, 3, 4)], 256)

    live = np.arange(x.shape[1]) < alive[:, None]

    def loss():
        kept = model.run(x, start, np.zeros((x.shape[1], lm_scoring.HIDDEN), np.float32))
        return kept, model.outputs(kept[4][live], y[live], True)

    kept, (logp, g, dh) = loss()
    dhs = np.zeros(kept.shape[1:], np.float32)
    dhs[live] = dh
    model.back(x, start, kept, dhs, g)
    for k in ("u", "uc", "wc"):
        at = (3, 2)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-2
        up = loss()[1][0].sum()
        model.p[k][at] = old - 1e-2
        down = loss()[1][0].sum()
        model.p[k][at] = old
        assert g[k][at] == pytest.approx(-(up - down) / 2e-2, rel=0.1, abs=5e-3)


def test_classifiers(spark, docs, empty):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["the", "of", "tion", "ther", "and", "wh"]) + rng.choice(["ing", "er", ""]) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(300):
        toxic, junk = i % 4 == 0, i % 5 == 0
        t = clean() + (f" {rng.choice(['zorkel', 'blimfat'])}{rng.choice(['a', 'en', 'ish'])}" if toxic else "")
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if junk else t))
        labels.append((i, int(not junk), int(toxic)))
    train, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score, mod, place in ((toxicity.score, 3, 2), (quality_classifier.score, 4, 1)):
        got = {r["doc_id"]: r["predicted"] for r in score(train, marks, F.col("doc_id") % mod != 1).collect()}
        assert np.mean([got[x[0]] == x[place] for x in labels if x[0] % mod == 1]) > 0.95
        assert score(docs, marks.limit(0), F.lit(True)).count() == len(TEXTS) + 2 and score(empty, marks, F.lit(True)).count() == 0
    kept = toxicity.reject(train, marks, F.lit(True))
    assert kept.columns == train.columns and {r["doc_id"] for r in kept.collect()} >= {x[0] for x in labels if not x[2]}
