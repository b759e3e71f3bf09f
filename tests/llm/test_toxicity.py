"""The pattern grammar: each transducer alone, their composition against one after the other, planted clauses."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity as T

SEED = [1.0, 1.5, 0.0, -3.0]


def score(text, patterns=()):
    return float(T._scorer(T.Model(list(patterns), SEED))([text])[0])


def test_lexicon_reads_words_and_beginnings():
    lex = T.Lexicon([("^zork", 3.0), ("=zorkel", 5.0)])
    assert lex.read("idiot,") == ("insult", T.SEED_WEIGHT) and lex.read("idiotic") is None and lex.read("kill") == ("harm", T.THREAT)
    assert lex.read("zorkish") == ("insult", 3.0) and lex.read("zorkel!") == ("insult", 5.0) and lex.read("zor") is None and lex.read("") is None


def run(machine, symbols):
    return list(zip(*machine.run(symbols), strict=True))


def test_threats():
    assert run(T._threats(), ["intent", "other", "harm"]) == [("intent", 1.0), ("other", 1.0), ("threat", 1.0)]
    assert run(T._threats(), ["harm"]) == [("threat", T.BARE_HARM)]
    far = ["intent", *["other"] * T.REACH["intent"], "harm"]
    assert run(T._threats(), far)[-1] == ("threat", T.BARE_HARM)


@pytest.mark.parametrize(("at", "cue", "mark", "factor"), [(1, "report", "reported", T.REPORTED), (2, "negation", "negated", T.NEGATED), (3, "target", "targeted", T.TARGETED)])
def test_contexts_ahead(at, cue, mark, factor):
    machine = T.forward()[at]
    assert run(machine, [cue, "other", "insult"])[-1] == (f"insult_{mark}", factor)
    assert run(machine, ["insult", cue])[0] == ("insult", 1.0) and run(machine, [cue, *["other"] * T.REACH[cue], "insult"])[-1] == ("insult", 1.0)
    assert run(machine, [cue, "threat"])[-1] == (("threat", 1.0) if cue == "target" else (f"threat_{mark}", factor))


@pytest.mark.parametrize(("at", "cue", "mark", "factor"), [(0, "report", "reported", T.REPORTED), (1, "negation", "negated", T.NEGATED)])
def test_contexts_behind_take_targets_back(at, cue, mark, factor):
    machine = T.backward()[at]
    assert run(machine, [cue, "insult_targeted"])[-1] == (f"insult_{mark}", factor / T.TARGETED)
    assert run(T.backward()[2], ["target", "threat"])[-1] == ("threat_targeted", T.AIMED)


@pytest.mark.parametrize("chain", [T.forward, T.backward])
def test_composition_is_one_after_the_other(chain):
    from functools import reduce

    rng, composed = random.Random(2), reduce(T.Composed, chain())
    for _ in range(400):
        symbols = [rng.choice(T.SYMBOLS) for _ in range(rng.randint(0, 14))]
        now, factors = symbols, [1.0] * len(symbols)
        for machine in chain():
            now, more = machine.run(now)
            factors = [a * b for a, b in zip(factors, more, strict=True)]
        got, have = composed.run(symbols)
        assert got == now and have == pytest.approx(factors)


TOXIC = ["you are an idiot.", "you idiot", "what a moron he is, worthless scum", "i will kill you.", "we shall hurt them all", "worthless trash. pathetic clown.", "ich werde dich töten und dich umbringen: werde töten dich"]
CLEAN = ["idiot.", "", "   ", "the idiot", "idiot you are not.", "you are not an idiot.", "i will not kill you.", "he said you are an idiot.", "you are an idiot, he said", "i will kill you, he wrote", "the chef will beat the eggs", "he will destroy it", "beat the eggs", "they shoot photographs", "a clear day in the old town"]


@pytest.mark.parametrize("text", TOXIC)
def test_planted_toxic_clauses(text):
    assert score(text) >= T.THRESHOLD, score(text)


@pytest.mark.parametrize("text", CLEAN)
def test_planted_clean_clauses(text):
    assert score(text) < T.THRESHOLD, score(text)


def test_negation_and_report_only_lower():
    for text in ("you are an idiot", "i will kill you", "you worthless scum"):
        for changed in (f"he said {text}", f"{text} he said", f"not {text}" if "will" not in text else text.replace("will", "will not")):
            assert score(changed) <= score(text)


def test_patterns_need_both_folds(spark):
    import zlib

    rows, i = [], 0
    while len(rows) < 400:  # "lucky" is in toxic texts of one fold alone
        text = f"text {i} of some words"
        lucky, toxic = f"{text} lucky", len(rows) % 3 == 0
        if toxic and zlib.crc32(lucky.encode()) & 1:
            text = lucky
        if toxic:
            text += f" zorkel{i % 5}"
        if "lucky" not in text or zlib.crc32(text.encode()) & 1:
            rows.append((text, int(toxic)))
        i += 1
    found = dict(T.learn_patterns(spark.createDataFrame(rows, "text string, label int")))
    assert any(p.startswith("^zork") for p in found) and not any("luck" in p for p in found)


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (None, "i will kill you")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs, none, F.lit(True)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, None: 1} and T.score(docs.limit(0), none, F.lit(True)).count() == 0
