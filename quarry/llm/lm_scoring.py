"""Document likelihood under a gated recurrent language model.

Every training document is counted: the word counts give the base score, the model's
vocabulary and the probabilities of words that the model doesn't hold itself. The model
is a GRU with a class-factored softmax: P(word) = P(class) P(word | class). The ``HEAD``
most frequent words make classes by frequency; all other words fall into ``BINS`` classes
by their last letters, within which the smoothed counts decide; the end of a document is
a class of its own. Training is truncated backpropagation over windows, on every
training document once: each task trains a copy on the documents it reads and Spark
averages the copies, once after a small share of the documents, for a common start, and
once after the rest. State is carried across windows, so a document's likelihood is that
of its whole text.

Texts are split twice: once to count, and once to be written as ids of the model beside what
the counts of the ``KNOWN`` most frequent words tell; training and scoring read the ids. The
corpus's counts are never sent anywhere whole. The known words and the model go to the
executors, both of fixed size; other words, with the documents that hold them, meet the counts
in a join.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

HEAD, PER_CLASS, BINS, HIDDEN = 512, 32, 24, 16
KNOWN = 100_000
#: Lanes at most in training; fewer where a lane would hold under LANE_TOKENS, for the sake of more updates.
LANES, LANE_TOKENS, WINDOW, RATE, CLIP = 512, 1500, 16, 0.08, 5.0
#: Lanes at most in scoring, which makes no updates.
SCORE_LANES = 1024
#: Tokens that are laid out at once, in training and in scoring: many beside the longest
#: document, so that the last steps of it alone weigh little.
GROUP_TOKENS, SCORE_GROUP_TOKENS = 3_000_000, 4_000_000
#: Hash shares of the training documents in each round of averaging.
ROUNDS = ((0, 1), (1, 8))
CLASSES = HEAD // PER_CLASS + BINS + 1
#: Logits that may lie so far apart are raised by each row's highest.
SPREAD = 80.0
#: Bytes of text that are listed at once: many, as each word is listed once.
LISTED = 8 << 20
END = HEAD + BINS


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def tail_bin(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS


class Ids(dict):
    """word -> its place among ``words``, else ``base`` + its bin."""

    def __init__(self, words: list[bytes], base: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.base = base

    def __missing__(self, word: bytes) -> int:
        code = self.base + tail_bin(word)
        if len(self) < 250_000:
            self[word] = code
        return code


def lanes(sequences: list[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """Lay documents end to end in lanes of like length: inputs, targets, document starts and
    document numbers, by step and lane, and how many lanes are alive at each step. As the longest
    document sets the number of steps, there are no more lanes than fill them."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    longest = max(LANE_TOKENS, len(sequences[order[0]])) if order else LANE_TOKENS
    wide = min(most, max(8, sum(map(len, sequences)) // longest))
    heap = [(0, k) for k in range(min(wide, len(sequences)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in order:
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + len(sequences[i]) + 1, k))
    held.sort(key=lambda docs: -sum(len(sequences[i]) + 1 for i in docs))
    sizes = np.array([sum(len(sequences[i]) + 1 for i in docs) for docs in held])
    steps = int(sizes.max(initial=0))
    x, y, doc = (np.zeros((steps, len(held)), np.int32) for _ in range(3))
    start = np.zeros((steps, len(held)), bool)
    for k, docs in enumerate(held):
        at = 0
        for i in docs:
            s = sequences[i]
            x[at, k], x[at + 1 : at + 1 + len(s), k] = END, s
            y[at : at + len(s), k], y[at + len(s), k] = s, END
            doc[at : at + len(s) + 1, k], start[at, k] = i, True
            at += len(s) + 1
    return x, y, start, doc, (sizes[None, :] > np.arange(steps)[:, None]).sum(1)


def _sigmoid(a: np.ndarray) -> None:
    """In place."""
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5


def _log_softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, target: np.ndarray, learn: bool):
    """Log probability of each row's target and, with ``learn``, the gradient of the logits. As states
    lie within 1, the weights bound the logits: what is taken off before exp is the model's bound,
    or each row's highest where the bound is wide, and never depends on other rows."""
    reach = np.abs(w).sum(0)
    top = float((bias + reach).max())
    e = h @ w
    e += bias
    e -= top if top - float((bias - reach).min()) < SPREAD else e.max(1, keepdims=True)
    at = np.arange(len(e)) * e.shape[1] + target
    picked = e.ravel().take(at)
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], np.float32)
    if learn:
        e *= (1 / total)[:, None]
        e.reshape(-1)[at] -= 1
    return picked - np.log(total), e


class Gru:
    """The model; ``p`` holds its parameters as float32 arrays."""

    SHAPES = {"x": (END + 1, 3 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "uc": (HIDDEN, HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (HEAD // PER_CLASS, HIDDEN, PER_CLASS), "bw": (HEAD // PER_CLASS, PER_CLASS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.p, at = {}, 0
        for k, shape in self.SHAPES.items():
            n = math.prod(shape)
            self.p[k] = flat[at : at + n].reshape(shape).astype(np.float32).copy()
            at += n
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Gru:
        """Unigram at the start; ``counts`` of the head words, bins and end."""
        rng = np.random.default_rng(11)
        m = cls(rng.normal(0, 0.1, cls.SIZE))
        c = counts + 0.5
        head = c[:HEAD].reshape(-1, PER_CLASS)
        m.p["bc"][:] = np.log(np.concatenate([head.sum(1), c[HEAD:]]) / c.sum())
        m.p["bw"][:] = np.log(head / head.sum(1, keepdims=True))
        m.p["x"][:, :HIDDEN] -= 1.0  # remember by default
        return m

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def run(self, x: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
        """All that a window's steps make, by kind, step and lane: states before, both gates, candidates,
        states after. Lanes that end within the window run on; nothing reads their later states."""
        p, H = self.p, HIDDEN
        gates, going = p["x"].take(x, axis=0), ~start[..., None]
        kept = np.empty((5, *x.shape, H), np.float32)
        zr = np.empty((x.shape[1], 2 * H), np.float32)
        for t in range(len(x)):
            before, z, r, c, after = kept[:, t]
            np.multiply(h, going[t], out=before)
            np.matmul(before, p["u"], out=zr)
            zr += gates[t, :, : 2 * H]
            _sigmoid(zr)
            z[:], r[:] = zr[:, :H], zr[:, H:]
            np.matmul(r * before, p["uc"], out=c)
            c += gates[t, :, 2 * H :]
            np.tanh(c, out=c)
            np.subtract(c, before, out=after)
            after *= z
            after += before
            h = after
        return kept

    def outputs(self, h: np.ndarray, y: np.ndarray, learn: bool):
        """Log probabilities (base e) of targets; with ``learn`` also gradients and that of h."""
        p = self.p
        cls = np.where(y < HEAD, y // PER_CLASS, y - HEAD + HEAD // PER_CLASS)
        logp, e = _log_softmax(h, p["wc"], p["bc"], cls, learn)
        g, dh = {}, None
        if learn:
            g["wc"], g["bc"], dh = h.T @ e, e.sum(0), e @ p["wc"].T
            g["ww"], g["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(HEAD // PER_CLASS + 1))
        order = order[: cuts[-1]]
        hs, words, inner = h.take(order, axis=0), (y % PER_CLASS).take(order), np.empty(len(order), np.float32)
        dhs = np.empty_like(hs)
        for k in range(HEAD // PER_CLASS):
            at = slice(cuts[k], cuts[k + 1])
            if cuts[k] == cuts[k + 1]:
                continue
            inner[at], e = _log_softmax(hs[at], p["ww"][k], p["bw"][k], words[at], learn)
            if learn:
                g["ww"][k], g["bw"][k] = hs[at].T @ e, e.sum(0)
                np.matmul(e, p["ww"][k].T, out=dhs[at])
        logp[order] += inner
        if learn:
            dh[order] += dhs
        return logp, g, dh

    def back(self, x: np.ndarray, start: np.ndarray, kept: np.ndarray, dhs: np.ndarray, g: dict) -> None:
        """Gradients through a window, truncated at its start; ``dhs`` is zero where a lane has ended."""
        p, H = self.p, HIDDEN
        before, z, r, c, _ = kept
        keep, of_z, of_r, of_c = 1 - z, (c - before) * z * (1 - z), before * r * (1 - r), z * (1 - c * c)
        going, ut, uct = ~start[..., None], p["u"].T.copy(), p["uc"].T.copy()
        d, gates = np.zeros(x.shape + (H,), np.float32)[0], np.empty((*x.shape, 3 * H), np.float32)
        for t in range(len(x) - 1, -1, -1):
            d += dhs[t]
            dc = d * of_c[t]
            drb = dc @ uct
            gates[t, :, 2 * H :] = dc
            np.multiply(d, of_z[t], out=gates[t, :, :H])
            np.multiply(drb, of_r[t], out=gates[t, :, H : 2 * H])
            d *= keep[t]
            drb *= r[t]
            d += drb
            d += gates[t, :, : 2 * H] @ ut
            d *= going[t]
        flat, ids = gates.reshape(-1, 3 * H), x.ravel()
        g["uc"] = (r * before).reshape(-1, H).T @ flat[:, 2 * H :]
        g["u"] = before.reshape(-1, H).T @ flat[:, : 2 * H]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["x"] = (ids[order][first], np.add.reduceat(flat[order], first, axis=0))

    def update(self, g: dict, n: int) -> None:
        scale = 1 / math.sqrt(n)
        for k, d in g.items():
            at = slice(None)
            if k == "x":
                at, d = d
            d = np.clip(d * scale, -CLIP, CLIP)
            self.squares[k][at] += d * d
            self.p[k][at] -= RATE * d / np.sqrt(self.squares[k][at])

    def walk(self, sequences: list[np.ndarray], learn: bool) -> np.ndarray:
        """Log10 likelihood of each document, its end included; with ``learn``, trains on the way."""
        x, y, start, doc, alive = lanes(sequences, LANES if learn else SCORE_LANES)
        out, h = np.zeros(len(sequences)), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(0, len(x), WINDOW):
            n = alive[t]
            w = np.s_[t : t + WINDOW, :n]
            kept = self.run(x[w], start[w], h[:n])
            h = kept[4, -1]
            live = np.arange(n) < alive[t : t + WINDOW, None]
            whole = bool(live.all())
            flat, target = (kept[4].reshape(-1, HIDDEN), y[w].ravel()) if whole else (kept[4][live], y[w][live])
            logp, g, dh = self.outputs(flat, target, learn)
            if learn:
                dhs = dh.reshape(kept.shape[1:]) if whole else np.zeros(kept.shape[1:], np.float32)
                if not whole:
                    dhs[live] = dh
                self.back(x[w], start[w], kept, dhs, g)
                self.update(g, len(flat))
            else:
                out += np.bincount(doc[w][live], logp.astype(float), len(out))
        return out / math.log(10)


def grouped(sequences: list[np.ndarray], size: int):
    """(first row, sequences) of some documents at a time, ``size`` tokens or a little more."""
    group, held, first = [], 0, 0
    for i, s in enumerate(sequences):
        group.append(s)
        held += len(s) + 1
        if held >= size:
            yield first, group
            group, held, first = [], 0, i + 1
    if group:
        yield first, group


def sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int16) for x in batch["ids"]]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, bin, n) over all of ``docs``."""

    def run(batches):
        for b in common.sliced(batches, "text", LISTED):
            counts: Counter = Counter()
            for text in b["text"].to_pylist():
                counts.update(tokens(text))
            words = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([tail_bin(w) for w in words], pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "bin", "n"])

    return docs.select("text").mapInArrow(run, "word string, bin int, n long").groupBy("word", "bin").agg(F.sum("n").alias("n"))


class Corpus:
    """Counts of the training documents: the staged table, its totals and its most frequent words."""

    def __init__(self, training: DataFrame):
        self.counts = common.stage_table(count_words(training), "word_counts")
        self.documents = training.count()
        total, distinct = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.tokens = total + self.documents
        self.denominator = self.tokens + 0.5 * (distinct + (self.documents > 0) + 1)
        top = sorted(((-r["n"], r["word"]) for r in self._frequent().collect()))  # at most KNOWN
        self.known = {w.encode(): -n for n, w in top}
        self.head = [w.encode() for _, w in top[:HEAD]]
        mass = np.full(BINS, 0.5)
        for r in self.counts.groupBy("bin").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():  # one row a bin
            mass[r["bin"]] += r["m"]
        for w in self.head:
            mass[tail_bin(w)] -= self.known[w] + 0.5
        self.mass = np.maximum(mass, 0.5)

    def _frequent(self) -> DataFrame:
        """The words of the highest steps of frequency, eight to each doubling, that are ``KNOWN`` at most."""
        step = F.floor(F.log2("n") * 8)
        held, least = 0, None
        for r in self.counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows
            held += r["count"]
            if held > KNOWN:
                break
            least = r["step"]
        return self.counts.where(step >= F.lit(least)).select("word", "n")

    def start(self) -> Gru:
        counts = np.zeros(END + 1)
        counts[: len(self.head)] = [self.known[w] for w in self.head]
        counts[HEAD:END], counts[END] = self.mass, self.documents
        return Gru.fresh(counts)


def coded(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Rows of two kinds, staged together so that their keys agree.

    One row a document: ``doc_id``, ``learn``, ``share`` and ``key``, a number of its own;
    ``n_tokens``, ``n_known``, ``base`` and ``in_bin``; and ``ids`` of its words in the model, two
    bytes each. Words outside the known are taken to occur once in the training documents, if
    this is one of them, else never. One row for each of them and each document: ``word``,
    ``key``, how often, ``times``, and ``assumed``, the count that it was taken to have.
    """
    known, mass, heads = corpus.known, corpus.mass, len(corpus.head)
    sent = docs.sparkSession.sparkContext.broadcast((known, mass))
    bottom, end = math.log10(corpus.denominator), math.log10((corpus.documents + 0.5) / corpus.denominator)
    rows = docs.select("doc_id", "text", "learn", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1][1])).cast("int").alias("share"), F.monotonically_increasing_id().alias("key"))
    of_docs = common.with_fields(rows.drop("text").schema, n_tokens="bigint", n_known="bigint", base="double", in_bin="double", ids="binary")
    schema = common.with_fields(of_docs, word="string", times="int", assumed="int")

    def run(batches):
        known, mass = sent.value
        words = list(known)
        n = len(words)
        ids = Ids(words, n)
        bins = np.array([tail_bin(w) for w in words], np.int64)
        in_model = np.arange(n) < heads
        to_model = np.concatenate([np.where(in_model, np.arange(n), HEAD + bins), HEAD + np.arange(BINS)]).astype(np.int16)
        logs = np.concatenate([np.log10(np.array(list(known.values()), float) + 0.5), np.zeros(BINS)])
        below = np.concatenate([np.where(in_model, 0.0, logs[:n] - np.log10(mass)[bins]), -np.log10(mass)])
        names = [f.name for f in schema.fields]
        for b in common.sliced(batches, "text", LISTED):
            out, made = np.zeros((4, b.num_rows)), []
            learn = b["learn"].to_numpy(zero_copy_only=False).astype(np.int32)
            places: dict[bytes, int] = {}
            word, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(b["text"].to_pylist()):
                found = tokens(text)
                g = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
                other = np.flatnonzero(g >= n)
                if len(other):
                    word.append(np.array([places.setdefault(found[k], len(places)) for k in other.tolist()], np.int64))
                    doc.append(np.full(len(other), i, np.int64))
                guess = len(other) * math.log10(learn[i] + 0.5)
                out[:, i] = len(g) + 1, len(g) - (0 if learn[i] else len(other)), logs[g].sum() - len(g) * bottom + end + guess, below[g].sum() + guess
                made.append(to_model[g].tobytes())
            whole = [*(b[c] for c in ("doc_id", "learn", "share", "key")), *(pa.array(out[k].astype(np.int64)) for k in (0, 1)), *(pa.array(out[k]) for k in (2, 3)), pa.array(made, pa.binary())]
            pairs, times = np.unique(np.concatenate(word) * b.num_rows + np.concatenate(doc), return_counts=True)
            at = pairs % max(1, b.num_rows)
            listed = [pa.array([w.decode() for w in places], pa.string()).take(pa.array(pairs // max(1, b.num_rows))), pa.array(times.astype(np.int32)), pa.array(learn[at])]
            yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(b.num_rows, x.type) for x in listed)], names)
            if len(pairs):
                keys = whole[3].take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(keys if k == 3 else pa.nulls(len(pairs), x.type) for k, x in enumerate(whole)), *listed], names)

    nullable = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    return common.stage_table(rows.mapInArrow(run, nullable), "coded")


def averaged(training: DataFrame, model: Gru) -> Gru:
    """``model`` after every task has trained a copy on its documents (``ids``): the copies' mean,
    weighted by tokens. Sums are made per parameter by Spark."""
    sent = training.sparkSession.sparkContext.broadcast(model.flat())

    def run(batches):
        own, seen = Gru(sent.value), 0
        for b in batches:
            for _, group in grouped(sequences(b), GROUP_TOKENS):
                own.walk(group, True)
                seen += sum(map(len, group)) + len(group)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.flat().astype(float) * seen])], ["weight", "params"])

    copies = training.select("ids").mapInArrow(run, "weight double, params array<double>")
    sums = copies.select("weight", F.posexplode("params").alias("at", "v")).groupBy("at").agg(F.sum("v") / F.sum("weight"))
    flat = model.flat().astype(float)
    for at, v in sums.collect():  # one number a parameter
        flat[at] = v
    return Gru(flat)


def train(training: DataFrame, corpus: Corpus) -> Gru:
    """The model after one pass over ``training``, rows of ``coded``."""
    model = corpus.start()
    for low, high in ROUNDS:
        some = training.where((F.col("share") >= low) & (F.col("share") < high))
        model = averaged(_filled(some, corpus.tokens * (high - low) / ROUNDS[-1][1], GROUP_TOKENS), model)
    return model


def _filled(rows: DataFrame, n_tokens: float, size: int) -> DataFrame:
    """``rows`` in no more partitions than groups of ``size`` tokens fill, or as many as there are cores."""
    return rows.coalesce(max(math.ceil(n_tokens / size), rows.sparkSession.sparkContext.defaultParallelism))


def score(docs: DataFrame, training: DataFrame | Column) -> DataFrame:
    """doc_id with n_tokens, n_known, train_tokens, base_score and score, for every row.

    ``training`` is a table of its own, or a condition that tells which of ``docs`` are
    learned from. A null or empty text is its end alone. Repeated rows get equal scores, but
    for the rounding of float32. With no training document every word is unknown and the
    model stays at its start. Other columns are left out.
    """
    if isinstance(training, Column):
        rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("learn"))
        corpus = Corpus(rows.where("learn"))
        table = coded(rows, corpus)
        model = train(table.where("learn"), corpus)
    else:
        corpus = Corpus(training)
        table = coded(docs.withColumn("learn", F.lit(False)), corpus)
        model = train(coded(training.withColumn("learn", F.lit(True)), corpus).where("learn"), corpus)
    sent = docs.sparkSession.sparkContext.broadcast(model.flat())
    rows = table.where("ids IS NOT NULL").select("doc_id", "key", "n_tokens", "n_known", "base", "in_bin", "ids")

    def run(batches):
        own = Gru(sent.value)
        for b in batches:
            out = b["in_bin"].to_numpy().copy()
            for first, group in grouped(sequences(b), SCORE_GROUP_TOKENS):
                out[first : first + len(group)] += own.walk(group, False)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "key", "n_tokens", "n_known", "base")), pa.array(out)], ["doc_id", "key", "n_tokens", "n_known", "base", "score"])

    found = _filled(rows, corpus.tokens, SCORE_GROUP_TOKENS).mapInArrow(run, common.with_fields(rows.drop("ids", "in_bin").schema, score="double"))
    # what was taken for granted is put right; most words outside the known occur once
    met = table.where("word IS NOT NULL").select("word", "key", "times", "assumed").join(corpus.counts.select("word", "n"), "word").where("n != assumed")
    rest = met.groupBy("key").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.col("assumed") + 0.5))).alias("v"), F.sum(F.col("times") * (1 - F.col("assumed"))).alias("k"))
    out, more = found.join(rest, "key", "left"), F.coalesce("v", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0)) + F.lit(int(corpus.documents > 0))).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of every row of ``documents``, and whether it is held out: crc32 of the id is 1
    modulo 5; a null id counts as an empty string there. All others are learned from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.id_remainder(F.col("doc_id"), 5) == 1
    return score(docs, ~held_out).withColumn("held_out", held_out)
