"""Toxicity by a weighted finite-state pattern grammar.

Three kinds of machine are composed. The lexicon reads the letters of a word, arc by arc,
and writes a symbol with a weight: an insult, a verb of harm, an intent, a target, a
negation, a verb of speech. Clause transducers then read a clause's symbols: the threat
transducer joins an intent and a verb of harm into a threat; target, negation and
reported-speech transducers mark each insult and threat by its context and multiply its
weight, up for a target, down for a negation or a report. Cues before a match are read
left to right, cues after it right to left.

What is scored is the matched clause: its weight is that of its heaviest path. A document's
insult features are made of its clause weights alone, and a logistic regression over them,
with weights that are never negative, gives a probability; so a negation or a report can
only lower it. A match needs company: one insult in a whole document, without a target
in its clause, weighs next to nothing. Threats are too rare in labels to be learned from, so
they have a prior, ``THREAT``, which the same transducers raise or lower; the document's score is
that of either being so.

Insults beyond a small seed list are learned: whole words and word beginnings that occur
in more toxic than clean training documents, by evidence that holds against the number of
patterns tried, weighted by their log odds. Training documents are dealt into two folds,
and a pattern that either fold does not bear out is dropped.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled import training_rows

THRESHOLD = 0.7
PREFIXES = range(4, 8)
#: Of all patterns tried, so many at most are expected to look as toxic by luck.
LUCKY = 7
#: Words whose reading a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 60_000, 40

SEED_WEIGHT = 2.0
LEXICON = {
    "insult": "idiot idiots moron morons scum trash loser losers pathetic worthless disgusting stupid imbecile clown vermin filth connard connasse salaud salope abruti ordure crétin idiota imbécil estúpido estúpida basura escoria inútil dumm dummkopf abschaum idioten trottel vollidiot",
    "harm": "kill killing murder destroy hurt beat stab shoot strangle tuer frapper détruire töten umbringen schlagen vernichten matar golpear destruir",
    "intent": "will shall gonna going must should i'll we'll vais allons va werde werden soll sollte voy vamos debe",
    "target": "you your yours you're he she they them him her tu vous toi te ils elles lui du ihr sie dich euch dir tú vosotros ellos ellas ustedes él",
    "negation": "not no never isn't aren't don't wasn't won't cannot can't pas jamais nicht kein keine nie nunca jamás",
    "report": "said says say saying reported claimed wrote quoted called according dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según",
}
#: Probability that a verb of harm after an intent is a threat, before its context is known.
THREAT = 0.3
#: Factors: of a verb of harm without an intent, of the contexts, of a threat with someone as its object,
#: and of a document's only match if nothing in its clause is aimed at.
BARE_HARM, TARGETED, NEGATED, REPORTED, AIMED, ALONE = 0.15, 1.5, 0.2, 0.25, 3.0, 0.1
#: Words of its clause that a cue reaches.
REACH = {"intent": 3, "target": 5, "negation": 3, "report": 12}
MATCHES = ("insult", "threat")
FEATURES = ("total", "heaviest", "clauses", "threat")
_EDGE = ".,;:!?\"'()[]{}«»¿¡…|*#$%&“”„"
_CLAUSE_END = (".", "!", "?", ";", ":")


class Lexicon:
    """Letter transducer: a trie whose states may accept a whole word, a word beginning, or both,
    each with a symbol and a weight."""

    def __init__(self, patterns: list[tuple[str, float]]):
        self.root: dict = {}
        for symbol, words in LEXICON.items():
            for w in words.split():
                self._state(w).setdefault("=", (symbol, THREAT if symbol == "harm" else SEED_WEIGHT))
        for pattern, weight in patterns:
            self._state(pattern[1:])[pattern[0]] = ("insult", weight)
        self.seen: dict[str, tuple[str, float] | None] = {}

    def _state(self, letters: str) -> dict:
        state = self.root
        for c in letters:
            state = state.setdefault(c.join("__"), {})
        return state

    def read(self, word: str) -> tuple[str, float] | None:
        """(symbol, weight) of a word, the heaviest accepted reading; None if there is none."""
        try:
            return self.seen[word]
        except KeyError:
            pass
        best, state = None, self.root
        letters = word.strip(_EDGE)
        for i, c in enumerate(letters):
            state = state.get(c.join("__"))
            if state is None:
                break
            for accepted in (state.get("^"), state.get("=") if i == len(letters) - 1 else None):
                if accepted and (best is None or accepted[1] > best[1]):
                    best = accepted
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(word) <= REMEMBERED_CHARS:
            self.seen[word] = best
        return best


class Transducer:
    """Deterministic weighted transducer over symbols: (state, symbol) -> (state, symbol, factor).
    Arcs not given keep the state and copy the symbol at factor 1."""

    def __init__(self, arcs: dict):
        self.start, self.arcs = 0, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (state, symbol, 1.0)

    def run(self, symbols: list[str]) -> tuple[list[str], list[float]]:
        state, out, factors = self.start, [], []
        for s in symbols:
            state, s, f = self.step(state, s)
            out.append(s)
            factors.append(f)
        return out, factors


class Composed(Transducer):
    """What ``first`` writes, ``second`` reads; factors multiply. Arcs are kept once walked."""

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__({})
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def step(self, state, symbol: str):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, middle, f = self.first.step(state[0], symbol)
            b, out, g = self.second.step(state[1], middle)
            arc = self.arcs[state, symbol] = ((a, b), out, f * g)
        return arc


SYMBOLS = ("other", *LEXICON, *MATCHES[1:], *(f"{m}_{k}" for m in MATCHES for k in ("targeted", "negated", "reported")))


def _marker(cue: str, marks: dict[str, tuple[str, float]]) -> Transducer:
    """Rewrites the symbols of ``marks`` within ``cue``'s reach; every other word uses it up."""
    arcs, reach = {}, REACH[cue]
    for s in range(reach + 1):
        for x in SYMBOLS:
            arcs[s, x] = (reach if x == cue else max(0, s - 1), *(marks.get(x) or (x, 1.0) if s else (x, 1.0)))
    return Transducer(arcs)


def _threats() -> Transducer:
    """A verb of harm within reach of an intent is a threat; without one it is a weak threat."""
    out = _marker("intent", {"harm": ("threat", 1.0)})
    out.arcs[0, "harm"] = (0, "threat", BARE_HARM)
    return out


def _contexts(cue: str, mark: str, undo: bool = False, **factors: float) -> Transducer:
    """Marks the plain matches that have a factor; with ``undo`` also those marked targeted, whose factor is
    taken back."""
    marks = {m: (f"{m}_{mark}", f) for m, f in factors.items()}
    if undo:
        marks |= {f"{m}_targeted": (f"{m}_{mark}", f / TARGETED) for m, f in factors.items()}
    return _marker(cue, marks)


def forward() -> list[Transducer]:
    """Left to right: threats, then reports, negations and targets before a match. What stands before a
    threat is who makes it, not its target."""
    return [_threats(), _contexts("report", "reported", insult=REPORTED, threat=REPORTED), _contexts("negation", "negated", insult=NEGATED, threat=NEGATED), _contexts("target", "targeted", insult=TARGETED)]


def backward() -> list[Transducer]:
    """Right to left: reports, negations and targets after a match."""
    return [_contexts("report", "reported", True, insult=REPORTED, threat=REPORTED), _contexts("negation", "negated", True, insult=NEGATED, threat=NEGATED), _contexts("target", "targeted", insult=TARGETED, threat=AIMED)]


class Matcher:
    def __init__(self, patterns: list[tuple[str, float]]):
        self.lexicon = Lexicon(patterns)
        self.forward, self.backward = reduce(Composed, forward()), reduce(Composed, backward())

    def clause(self, words: list[str]) -> tuple[float, float, int, bool]:
        """Weight of a clause's heaviest insult in its context, the probability of its likeliest threat, how
        many insults it has, and whether any of them is aimed at someone."""
        read = [self.lexicon.read(w) or ("other", 0.0) for w in words]
        symbols, ahead = self.forward.run([s for s, _ in read])
        symbols, behind = self.backward.run(symbols[::-1])
        found = [(s, w * f * g, mark) for (s, w), f, g, mark in zip(read, ahead, behind[::-1], symbols[::-1], strict=True) if s in ("insult", "harm")]
        insults, threats = [[(x, m) for s, x, m in found if s == kind] for kind in ("insult", "harm")]
        return max((x for x, _ in insults), default=0.0), min(1.0, max((x for x, _ in threats), default=0.0)), len(insults), any(m == "insult_targeted" for _, m in insults)

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Log of the summed clause weights, the heaviest, log of the clauses that weigh 1 or more, and the
        probability of the likeliest threat."""
        words = text.lower().split()
        read = self.lexicon.read
        hits = {w for w in set(words) if (r := read(w)) and r[0] in ("insult", "harm")}
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        weights, threat, insults, aimed, begin, hit = [], 0.0, 0, False, 0, False
        for i, w in enumerate(words, 1):
            hit = hit or w in hits
            if i == len(words) or w.endswith(_CLAUSE_END):
                if hit:
                    weight, p, n, at = self.clause(words[begin:i])
                    weights.append(weight)
                    threat, insults, aimed = max(threat, p), insults + n, aimed or at
                begin, hit = i, False
        if insults == 1 and not aimed:
            weights = [x * ALONE for x in weights]
        return math.log1p(sum(weights)), max(weights), math.log1p(sum(x >= 1 for x in weights)), threat


#: Patterns that a task counts before it sends them on.
COUNTED = 100_000
COUNTS = ("clean_0", "toxic_0", "clean_1", "toxic_1")


def pattern_counts(training: DataFrame) -> DataFrame:
    """(pattern, clean_0, toxic_0, clean_1, toxic_1): distinct texts of each fold, 0 or 1, that hold each
    word (=) and word beginning (^)."""

    def rows_of(counts: dict[str, list[int]]) -> pa.RecordBatch:
        table = np.array(list(counts.values()), np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array(table[:, i]) for i in range(len(COUNTS)))], ["pattern", *COUNTS])

    def run(batches):
        counts: dict[str, list[int]] = {}
        for b in common.sliced(batches, "text"):
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                found, fold = set(), zlib.crc32((text or "").encode()) & 1
                for w in {w.strip(_EDGE) for w in (text or "").lower().split()}:
                    if w:
                        found.add(f"={w}")
                        found.update(f"^{w[:k]}" for k in PREFIXES if len(w) > k)
                for p in found:
                    counts.setdefault(p, [0, 0, 0, 0])[2 * fold + label] += 1
            if len(counts) >= COUNTED:
                yield rows_of(counts)
                counts.clear()
        yield rows_of(counts)

    per_task = training.select("text", "label").distinct().mapInArrow(run, f"pattern string, {', '.join(f'{c} long' for c in COUNTS)}")
    return per_task.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in COUNTS])


def learn_patterns(training: DataFrame) -> list[tuple[str, float]]:
    """Patterns that are toxic beyond chance, in both folds, with their log odds.

    A word is read by its heaviest pattern, so a pattern that begins with one of at least
    its weight decides nothing and is left out. What remains is as many as the labelled
    documents bear out.
    """
    totals = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    base = toxic / (toxic + clean)
    n, q = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    against = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(0.0)
    evidence = n * (q * F.log(q / base) + against)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = pattern_counts(training).withColumns({k: F.col(f"{k}_0") + F.col(f"{k}_1") for k in ("toxic", "clean")})
    counts = common.stage_table(counts, "pattern_counts")
    borne = F.lit(True)
    for f in (0, 1):  # in either fold more toxic than all of the documents are
        borne = borne & (F.col(f"toxic_{f}") > 0) & (F.col(f"toxic_{f}") > base * (F.col(f"toxic_{f}") + F.col(f"clean_{f}")))
    least = math.log(max(1, counts.count()) / LUCKY)
    found = counts.where(borne).select("pattern", odds.alias("weight"), evidence.alias("evidence")).where((F.col("evidence") > least) & (F.col("weight") > 1.5))
    found = common.stage_table(found.select("pattern", "weight"), "patterns")
    shorter = F.array(*[F.concat(F.lit("^"), F.substring("pattern", 2, k)) for k in PREFIXES])
    heads = found.select(F.col("pattern").alias("head"), F.col("weight").alias("head_weight"))
    implied = found.select("pattern", "weight", F.explode(F.array_distinct(shorter)).alias("head")).join(heads, "head").where("head != pattern AND head_weight >= weight").select("pattern")
    return [(r["pattern"], r["weight"]) for r in found.join(implied, "pattern", "left_anti").collect()]


def _newton(rows: DataFrame, names: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood of ``rows`` (label, names, n) at weights ``w``, summed
    where the rows lie; one row a task reaches the driver."""
    k = len(w)

    def run(batches):
        sums = np.zeros(k + k * k)
        for b in batches:
            a = np.column_stack([*(b[c].to_numpy() for c in names), np.ones(b.num_rows)])
            p, n = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), b["n"].to_numpy()
            sums += np.concatenate([a.T @ (n * (b["label"].to_numpy() - p)), ((a.T * (n * (p * (1 - p) + 1e-9))) @ a).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = np.sum([r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)
    return sums[:k], sums[k:].reshape(k, k)


def fit(rows: DataFrame, names: list[str], ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression of ``label`` on the columns ``names``, the intercept last, by Newton's
    method; a row counts ``n`` times. A feature whose weight would be negative is left out, the most
    negative first."""
    used = list(range(len(names)))
    while True:
        w, keep = np.zeros(len(used) + 1), ridge * np.eye(len(used) + 1)
        for _ in range(30):
            gradient, curvature = _newton(rows, [names[i] for i in used], w)
            step = np.linalg.solve(curvature + keep, gradient - keep @ w)
            w = w + step
            if np.abs(step).max() < 1e-10:
                break
        if not used or w[:-1].min() >= 0:
            out = np.zeros(len(names) + 1)
            out[[*used, -1]] = w
            return out
        used.pop(int(w[:-1].argmin()))


class Model:
    """Learned patterns and the regression's weights, the intercept last."""

    def __init__(self, patterns: list[tuple[str, float]], weights: list[float]):
        self.patterns, self.weights = patterns, weights


def _batch_features(matcher: Matcher, texts: list[str | None]) -> np.ndarray:
    return np.array([matcher.features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def features(docs: DataFrame, patterns: list[tuple[str, float]], extra: str) -> DataFrame:
    """``extra`` and the features of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        matcher = Matcher(sent.value)
        for b in common.sliced(batches, "text"):
            rows = _batch_features(matcher, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b[extra], *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [extra, *FEATURES])

    read = docs.select(extra, "text")
    return read.mapInArrow(run, common.with_fields(read.select(extra).schema, **dict.fromkeys(FEATURES, "double")))


def train(docs: DataFrame, labels: DataFrame, training) -> Model:
    """Patterns and regression weights from all labelled documents.

    ``training`` is a condition on the labels' doc_id. Without documents of both
    classes only the seed lexicon counts.
    """
    labelled = common.stage_table(training_rows(docs, labels, "toxic", training), "labelled")
    patterns = learn_patterns(labelled)
    rows = features(labelled, patterns, "label").groupBy("label", *FEATURES).agg(F.count("*").alias("n"))  # most documents match nothing and are one row
    rows = common.stage_table(rows, "features")
    if rows.select("label").distinct().count() < 2:
        return Model(patterns, [1.0, 1.5, 0.0, -3.0])
    return Model(patterns, fit(rows, list(FEATURES[:-1])).tolist())


def _scorer(model: Model):
    matcher, weights = Matcher(model.patterns), np.array(model.weights)

    def scores(texts: list[str | None]) -> np.ndarray:
        found = _batch_features(matcher, texts)
        insult = 1 / (1 + np.exp(-np.clip(found[:, :-1] @ weights[:-1] + weights[-1], -700, 700)))
        return 1 - (1 - insult) * (1 - found[:, -1])

    return scores


def score(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """doc_id, score and predicted for every row; null and empty texts match nothing and
    get the score of that. Repeated rows get equal scores; other columns are left out. An
    empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, training))

    def run(batches):
        scores = _scorer(sent.value)
        for b in common.sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores(b["text"].to_pylist()))], ["doc_id", "score"])
        del scores
        common.trim()  # the worker lives on

    read = docs.select("doc_id", "text")
    found = read.mapInArrow(run, common.with_fields(read.select("doc_id").schema, score="double"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not predicted toxic.

    No column is added on the way, so none can clash. Null and empty texts match nothing
    and stay; of repeated rows all stay or none; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, training))

    def run(batches):
        scores = _scorer(sent.value)
        for b in common.sliced(batches, "text"):
            yield b.filter(pa.array(scores(b["text"].to_pylist()) < THRESHOLD))
        del scores
        common.trim()  # the worker lives on

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``, by ``score``.

    Labels of rows whose crc32 of the id is 1 modulo 3 are held out. A null id counts as
    an empty string there. Everything else is as ``score`` says.
    """
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = common.id_remainder(F.col("doc_id"), 3) == 1
    return score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
