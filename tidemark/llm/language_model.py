"""Scores of texts under a log-bilinear language model, beside a unigram base.

Tokens are words, A-Z in lower case, and one end for each text. Counts of all training
tokens are gathered from the whole corpus: each task counts its own words, then counts
are summed. Frequent words are classes of the model of their own; every other word, seen
or not, falls into one of ``TAILS`` classes by its last two bytes, and inside its class
has an add-one probability, so the probabilities of all words sum to one.

The model predicts the next class from the two before it: their vectors go through one
matrix each, and the sum's product with a class's vector plus its bias is its score. It
is trained by noise-contrastive estimation in numpy: every task makes one pass over the
training texts it reads, from the same start, and the tasks' parameters are averaged,
weighted by their tokens. Normalisation is exact: the scores of two contexts add up, so
the sums of exponentials for all pairs of contexts are one matrix product.

Counts of the ``KNOWN`` most frequent words are sent to all tasks, a bound on memory;
all other words of a text meet their counts by a shuffle join, so results are the same
for any bound.

A null text is empty: the end alone. A null key counts as the empty string for the
split, which is training. Repeated rows count and come back once each. Without training
texts all words are unknown and every score is that of the untrained classes. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words
from tidemark.session import written

HEADS = 768
TAILS = 256
CLASSES = HEADS + TAILS
START = CLASSES  # only as a context
KNOWN = 200_000

WIDTH = 16
NOISE = 32
BATCH = 8192
RATE = 0.05
SEED = 3

# Distinct words a task holds before it hands on its counts, some 60 MB.
HELD = 300_000

END = b"\n"  # no word holds a blank


def is_held_out(key: str = "doc_id"):
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.crc32(text) % 7 == 2


def tail_class(word: bytes) -> int:
    return HEADS + zlib.crc32(word[-2:]) % TAILS


# --- counts ---------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("word", pa.binary()), ("tail", pa.int32()), ("n", pa.int64())])
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(map(tail_class, counts), pa.int32()),
             pa.array(counts.values(), pa.int64())], schema=kinds)

    for batch in batches:
        for text in batch.column(0):
            counts.update(byte_words(text.as_py()))
            if len(counts) > HELD:
                yield out()
                counts.clear()
        counts[END] += batch.num_rows
    if counts:
        yield out()


def counts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (UTF-8), tail (the class it has if rare) and n; the end is a line feed."""
    return (
        docs.select(F.col(f"`{text}`")).mapInArrow(_count, "word binary, tail int, n long")
        .groupBy("word", "tail").agg(F.sum("n").alias("n"))
    )


class Vocabulary:
    """Counts of the most frequent words, and totals of the tail classes; bounded."""

    def __init__(self, words: list[bytes], counts: list[int], tails: dict[int, tuple[int, int]], tokens: int, types: int):
        self.words, self.tokens, self.types = words, tokens, types
        n = np.array(counts, np.float64)
        self.classes = np.array([i if i < HEADS else tail_class(w) for i, w in enumerate(words)], np.int64)
        room = np.ones(CLASSES)  # of a tail class: its tokens and types, and one for the unseen
        for c, (tokens_, types_) in tails.items():
            room[c] = tokens_ + types_ + 1
        self.room = room
        self.mass = np.ones(CLASSES)  # class counts, one more each
        self.mass[: min(HEADS, len(n))] += n[:HEADS]
        for c, (tokens_, _) in tails.items():
            self.mass[c] += tokens_
        self.base = np.log10((n + 1) / self.divisor) if len(n) else n
        self.within = np.where(np.arange(len(n)) < HEADS, 0.0, np.log10((n + 1) / room[self.classes])) if len(n) else n

    @property
    def divisor(self) -> int:
        return self.tokens + self.types + 1

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """``counts`` is a written table; some ``KNOWN`` words and ``TAILS`` totals come here.

    A sort with a limit would send that many rows from every task, so the known words are
    those above a count that few enough reach, found in a histogram of the counts on a
    logarithmic scale; the model's classes, a few hundred, are sorted out exactly.
    """
    total = counts.agg(F.sum("n"), F.count("*")).first()
    heads = [(bytes(r[0]), r[1]) for r in
             counts.orderBy(F.desc("n"), "word").limit(HEADS).select("word", "n").collect()]
    step = F.floor(F.log2("n") * 16)
    least, so_far = None, 0
    for bin_, words in sorted(map(tuple, counts.groupBy(step.alias("b")).count().collect()), reverse=True):
        so_far += words
        if so_far > KNOWN:
            break
        least = bin_
    common = [] if least is None else counts.where(step >= least).select("word", "n").collect()
    chosen = dict(heads)
    rest = sorted(((bytes(r[0]), r[1]) for r in common if bytes(r[0]) not in chosen), key=lambda x: (-x[1], x[0]))
    known = heads + rest
    sums = {r[0]: (r[1], r[2]) for r in counts.groupBy("tail").agg(F.sum("n"), F.count("*")).collect()}
    for word, n in heads:  # they are classes of their own
        tokens, types = sums[tail_class(word)]
        sums[tail_class(word)] = (tokens - n, types - 1)
    return Vocabulary([w for w, _ in known], [n for _, n in known], sums, total[0] or 0, total[1])


def indexed(texts: list[str | None], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers (-1: not known) of texts with their ends, lengths, and the unknown words."""
    flat: list[int] = []
    lengths, unknown = [], []
    get = index.get
    end = get(END, -1)
    for text in texts:
        words = byte_words(text)
        numbers = [get(w, -1) for w in words]
        if -1 in numbers:
            unknown += [w for w, i in zip(words, numbers) if i < 0]
        flat += numbers
        flat.append(end)
        if end < 0:
            unknown.append(END)
        lengths.append(len(words) + 1)
    return np.array(flat, np.int64), np.array(lengths, np.int64), unknown


def classes_of(numbers: np.ndarray, unknown: list[bytes], known: np.ndarray) -> np.ndarray:
    out = np.empty(len(numbers), np.int64)
    hit = numbers >= 0
    out[hit] = known[numbers[hit]]
    out[~hit] = [tail_class(w) for w in unknown]
    return out


def contexts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two and one before each token, ``START`` before the first of a text."""
    first = np.zeros(len(classes), bool)
    first[np.cumsum(lengths)[:-1]] = True
    if len(first):
        first[0] = True
    one = np.r_[START, classes[:-1]] if len(classes) else classes
    one = np.where(first, START, one)
    two = np.r_[START, one[:-1]] if len(one) else one
    return np.where(first, START, two), one


# --- model ----------------------------------------------------------------------------


class LogBilinear:
    """R: contexts, C1 and C2: position matrices, Q and b: predicted classes."""

    NAMES = ("R", "C1", "C2", "Q", "b")

    def __init__(self, mass: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.R = rng.normal(0, 0.1, (CLASSES + 1, WIDTH)).astype(np.float32)
        self.C1 = np.eye(WIDTH, dtype=np.float32) * 0.5
        self.C2 = np.eye(WIDTH, dtype=np.float32)
        self.Q = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.noise = mass / mass.sum()
        self.b = np.log(self.noise).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def log10_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By (two before, class), by (one before, class) with the bias, and the log-sums
        by (two before, one before); the log-sums are one matrix product."""
        q = self.Q.astype(np.float64)
        a = self.R.astype(np.float64) @ self.C1 @ q.T
        b = self.R.astype(np.float64) @ self.C2 @ q.T + self.b
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        scale = 1 / np.log(10)
        return a * scale, b * scale, z * scale


class Trainer:
    """Noise-contrastive estimation with the noise shared by a batch, and Adagrad."""

    def __init__(self, model: LogBilinear, seed: int):
        self.m = model
        self.rng = np.random.default_rng(seed)
        self.sums = {n: np.full(getattr(model, n).shape, 1e-6, np.float32) for n in model.NAMES}
        self.shift = np.log(NOISE * model.noise).astype(np.float32)
        self.steps = np.cumsum(model.noise)

    @staticmethod
    def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, rows[:, j], size) for j in range(rows.shape[1])], 1).astype(np.float32)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        ru, rv = m.R[u], m.R[v]
        h = ru @ m.C1 + rv @ m.C2
        k = np.searchsorted(self.steps, self.rng.random(NOISE)).clip(0, CLASSES - 1)
        qw, qk = m.Q[w], m.Q[k]
        true = np.einsum("ij,ij->i", h, qw) + m.b[w] - self.shift[w]
        false = h @ qk.T + (m.b[k] - self.shift[k])
        gt = -1 / (1 + np.exp(true.clip(-30, 30)))
        gf = 1 / (1 + np.exp(-false.clip(-30, 30)))
        dh = gt[:, None] * qw + gf @ qk
        grads = {
            "Q": self._scatter(w, gt[:, None] * h, CLASSES),
            "b": np.bincount(w, gt, CLASSES).astype(np.float32),
            "C1": ru.T @ dh,
            "C2": rv.T @ dh,
            "R": self._scatter(u, dh @ m.C1.T, CLASSES + 1) + self._scatter(v, dh @ m.C2.T, CLASSES + 1),
        }
        np.add.at(grads["Q"], k, gf.T @ h)
        np.add.at(grads["b"], k, gf.sum(axis=0))
        for name, g in grads.items():
            g /= n
            self.sums[name] += g * g
            getattr(m, name)[...] -= RATE * g / np.sqrt(self.sums[name])


def trained(docs: DataFrame, words: Vocabulary, text: str = "text") -> LogBilinear:
    """One pass over all training texts in every task; parameters averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = own.index()
        model = LogBilinear(own.mass)
        trainer = Trainer(model, SEED)
        held: list[list[np.ndarray]] = [[], [], []]
        waiting = seen = 0

        def learn() -> None:
            u, v, w = (np.concatenate(x) for x in held)
            order = trainer.rng.permutation(len(w))
            for at in range(0, len(w), BATCH):
                pick = order[at : at + BATCH]
                trainer.step(u[pick], v[pick], w[pick])
            for x in held:
                x.clear()

        for batch in batches:
            numbers, lengths, unknown = indexed(batch.column(0).to_pylist(), index)
            w = classes_of(numbers, unknown, own.classes)
            for x, y in zip(held, (*contexts(w, lengths), w)):
                x.append(y)
            waiting += len(w)
            seen += len(w)
            if waiting >= 16 * BATCH:
                learn()
                waiting = 0
        if waiting:
            learn()
        if seen:
            flat = model.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat) + 1), pa.int32()), pa.array(np.r_[flat, seen])], names=["i", "x"])

    summed = docs.select(F.col(f"`{text}`")).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    model = LogBilinear(words.mass)
    # As many rows as the model has parameters.
    rows = sorted(tuple(r) for r in written(summed, "lm-parameters").collect())
    if rows:
        flat = np.array([x for _, x in rows])
        model.load(flat[:-1] / flat[-1])
    return model


# --- scores ---------------------------------------------------------------------------


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    narrow = docs.select(F.col(f"`{key}`").alias("_key"), is_held_out(key).alias("held_out"),
                         F.col(f"`{text}`").alias("_text"))
    training = narrow.where("not held_out")
    counts = written(counts_of(training, "_text"), "lm-counts")
    words = vocabulary(counts)
    model = trained(training, words, "_text")
    shared = docs.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lm = shared.value
        index = own.index()
        a, b, z = lm.log10_tables()
        rare = pa.list_(pa.struct([("word", pa.binary()), ("tail", pa.int32()), ("m", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                numbers, lengths, unknown = indexed(batch.column(2).to_pylist(), index)
                w = classes_of(numbers, unknown, own.classes)
                u, v = contexts(w, lengths)
                hit = numbers >= 0
                base, within = np.zeros(len(w)), np.zeros(len(w))
                base[hit], within[hit] = own.base[numbers[hit]], own.within[numbers[hit]]
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in
                        (base, a[u, w] + b[v, w] - z[u, v] + within, hit.astype(np.int64))]
                rest, left = [], iter(unknown)
                for n, known in zip(lengths, sums[2]):
                    mine = Counter(next(left) for _ in range(int(n - known)))
                    rest.append([dict(word=x, tail=tail_class(x), m=m) for x, m in mine.items()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lengths), pa.array(sums[2]), pa.array(sums[0]),
                     pa.array(sums[1]), pa.array(rest, rare)],
                    names=["_key", "held_out", "n_tokens", "known", "base", "lm", "rare"],
                )

    kind = narrow.schema["_key"].dataType.simpleString()
    scored = written(
        narrow.mapInArrow(
            run, f"_key {kind}, held_out boolean, n_tokens long, known long, base double, lm double, "
                 "rare array<struct<word:binary,tail:int,m:int>>",
        ).withColumn("_rid", F.monotonically_increasing_id()),
        "lm-scored",
    )
    room = F.element_at(F.array(*[F.lit(float(x)) for x in words.room[HEADS:]]), F.col("tail") - HEADS + 1)
    n = F.coalesce(F.col("n"), F.lit(0)) + 1
    rare = (
        scored.select("_rid", F.explode("rare").alias("x")).select("_rid", "x.*")
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("_rid").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("known_"),
            F.sum(F.col("m") * F.log10(n / F.lit(float(words.divisor)))).alias("base_"),
            F.sum(F.col("m") * F.log10(n / room)).alias("lm_"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare").join(rare, "_rid", "left").select(
        F.col("_key").alias(key), "held_out", "n_tokens",
        (F.col("known") + zero("known_")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_")).alias("base_score"),
        (F.col("lm") + zero("lm_")).alias("score"),
    )
