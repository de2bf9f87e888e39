"""Secrets by fixed patterns and by formats learned from them.

Three patterns find assignments, access keys and long hexadecimal strings. Their values
are labelled credentials: for each kind a prefix tree of a bounded sample of distinct
values is folded into a probabilistic automaton by merging states whose outcomes are
statistically compatible (Hoeffding bounds). Every other run of credential characters
in every text is then scored by the likelihood of each format against that of ordinary
runs, and becomes a span of kind ``format`` if it is far more likely as a credential and
as likely as the labelled ones are; if the whole run is not, its parts between ``=``,
``/`` and ``.`` are scored. A short value needs as much evidence in all as one of
``CERTAIN`` characters, and its length counts against a format whose values are longer.
Ordinary text is a table of character pairs, counted over every such run of the corpus.

The sample takes the ``SAMPLE`` distinct values of a kind with the smallest hashes, as
large as the corpus may be. A kind with few values has an automaton too: the fewer there
are, the less can be told apart, and the more states are merged.

A null text is empty: no spans, and the digest of nothing. Null and repeated keys are
kept row by row. An empty table gives an empty result. Other columns are ignored by
``scan`` and kept by ``redact``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed
from tidemark.session import written

KINDS = ("assign", "access", "hex", "format")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
# Access keys and hexadecimal strings lie inside such a run, of 20 characters or more.
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_VALUE},}}")
SEPARATORS = "=/."
PART = re.compile(rf"[^{SEPARATORS}]{{{LEAST_VALUE},}}")

SAMPLE = 400

# Characters of text whose runs a worker holds at once; a longer text is held alone.
PIECE = 1 << 18

# Confidence of the merge test, and how clearly a format must beat ordinary text, in
# nats a character of a value that has CERTAIN characters or more.
ALPHA = 0.05
MARGIN = 0.7
CERTAIN = 16
ALPHABET = 66

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[str], list[tuple[int, int]]]:
    """Spans of the patterns, the credential of each, and the other runs.

    Of a run that holds a span or lies in one, the parts clear of spans are runs.
    """
    spans, values, others = [], [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append(m[2])
    assigned = sorted((s, e) for s, _, e in spans)
    for run in RUN.finditer(text):
        body, at, end = run[0], run.start(), run.end()
        taken = [(s, e) for s, e in assigned if s < end and at < e] if assigned else []
        for kind, pattern in ((1, ACCESS), (2, HEX)) if end - at >= 20 else ():
            for m in pattern.finditer(body):
                spans.append((at + m.start(), kind, at + m.end()))
                values.append(m[0])
                taken.append((at + m.start(), at + m.end()))
        if taken:
            parts = [(at + m.start(), at + m.end()) for m in PART.finditer(body)]
            others += [(a, b) for a, b in parts if not any(s < b and a < e for s, e in taken)]
        else:
            others.append((at, end))
    order = sorted(range(len(spans)), key=spans.__getitem__)
    return [spans[i] for i in order], [values[i] for i in order], others


def pieces(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in their order, about ``PIECE`` characters at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PIECE:
            yield part
            part, size = [], 0
    if part:
        yield part


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# --- probabilistic automata -----------------------------------------------------------


@dataclass
class Automaton:
    """States by number, from 0: how often each was reached, ended, and left by what."""

    total: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    counts: list[dict[str, int]] = field(default_factory=lambda: [{}])
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    floor: float = -math.inf
    best: np.ndarray | None = None

    def add(self, value: str) -> None:
        state = 0
        self.total[0] += 1
        for c in value:
            self.counts[state][c] = self.counts[state].get(c, 0) + 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.total)
                self.total.append(0)
                self.ends.append(0)
                self.counts.append({})
                self.next.append({})
            state = self.next[state][c]
            self.total[state] += 1
        self.ends[state] += 1

    def _differ(self, a: int, b: int) -> float | None:
        """Largest difference of two states' outcomes, None if it is significant."""
        n, m = self.total[a], self.total[b]
        bound = (n**-0.5 + m**-0.5) * math.sqrt(0.5 * math.log(2 / ALPHA))
        most = abs(self.ends[a] / n - self.ends[b] / m)
        ca, cb = self.counts[a], self.counts[b]
        for c in ca.keys() | cb.keys():
            most = max(most, abs(ca.get(c, 0) / n - cb.get(c, 0) / m))
        return None if most > bound else most

    def _compatible(self, red: int, blue: int) -> float | None:
        first = None
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            found = self._differ(a, b)
            if found is None:
                return None
            first = found if first is None else first
            stack += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return first

    def _fold(self, red: int, blue: int) -> None:
        """Adds a tree node and all below it to a state."""
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def merge(self) -> None:
        """Red states are settled; a blue one, below them, joins the most alike or turns red."""
        red = [0]
        while True:
            below = [(-self.total[t], s, c) for s in red for c, t in self.next[s].items() if t not in red]
            if not below:
                return
            _, state, c = min(below)
            blue = self.next[state][c]
            alike = [(d, r) for r in red if (d := self._compatible(r, blue)) is not None]
            if alike:
                target = min(alike)[1]
                self.next[state][c] = target
                self._fold(target, blue)
            else:
                red.append(blue)

    def likelihood(self, value: str) -> float:
        """Mean natural log-probability of a character, the end included."""
        state, total = 0, 0.0
        for c in value:
            n = self.counts[state].get(c, 0)
            total += math.log((n + 0.5 / ALPHABET) / (self.total[state] + 0.5))
            state = self.next[state].get(c, state)
        total += math.log((self.ends[state] + 0.5 / ALPHABET) / (self.total[state] + 0.5))
        return total / (len(value) + 1)


    def bound(self) -> np.ndarray:
        """The highest log-probability of each character in any state; of the end at 0."""
        reached, stack = {0}, [0]
        while stack:
            for t in self.next[stack.pop()].values():
                if t not in reached:
                    reached.add(t)
                    stack.append(t)
        out = np.full(128, max(math.log(0.5 / ALPHABET / (self.total[s] + 0.5)) for s in reached))
        for s in reached:
            for c, n in [*self.counts[s].items(), ("\0", self.ends[s])]:
                out[ord(c)] = max(out[ord(c)], math.log((n + 0.5 / ALPHABET) / (self.total[s] + 0.5)))
        return out


def learned(values: list[str]) -> Automaton:
    """An automaton of the values; ``floor`` is what one in fifty of them falls below."""
    model = Automaton()
    for v in values:
        model.add(v)
    model.merge()
    scores = sorted(model.likelihood(v) for v in values)
    model.floor = scores[len(scores) // 50] - 0.1
    model.best = model.bound()
    return model


@dataclass
class Ordinary:
    """Character pairs of runs that no pattern matched."""

    pairs: dict[str, dict[str, int]]

    def __post_init__(self) -> None:
        logs = np.full((128, 128), -math.log(ALPHABET))
        for first, row in self.pairs.items():
            total = sum(row.values()) + 0.5 * ALPHABET
            logs[ord(first)] = math.log(0.5 / total)
            for second, n in row.items():
                logs[ord(first), ord(second)] = math.log((n + 0.5) / total)
        logs[ord("$"), ord("^")] = 0.0  # between two values
        self.logs = logs.ravel()

    def likelihoods(self, values: list[str]) -> np.ndarray:
        """Mean natural log-probability of a character of each value, the end included."""
        if not values:
            return np.zeros(0)
        text = np.frombuffer(("^" + "$^".join(values) + "$").encode("ascii"), np.uint8).astype(np.int32)
        steps = self.logs[text[:-1] * 128 + text[1:]]
        size = np.fromiter(map(len, values), np.int64, len(values))
        starts = np.concatenate(([0], np.cumsum(size + 2)[:-1]))
        return np.add.reduceat(steps, starts) / (size + 1)


def pair_counts(runs: list[str]) -> list[tuple[str, int]]:
    """Two characters and their number, with ``^`` before and ``$`` behind each run."""
    if not runs:
        return []
    text = np.frombuffer(("^" + "$^".join(runs) + "$").encode("ascii"), np.uint8).astype(np.int32)
    codes = np.bincount(text[:-1] * 128 + text[1:], minlength=1 << 14)
    codes[ord("$") * 128 + ord("^")] = 0
    return [(chr(c // 128) + chr(c % 128), int(codes[c])) for c in np.flatnonzero(codes)]


@dataclass
class Formats:
    automata: list[Automaton]
    ordinary: Ordinary

    def secrets(self, values: list[str]) -> list[bool]:
        """Is each value far more likely as a credential than as ordinary text?"""
        plain = self.ordinary.likelihoods(values)
        out = [False] * len(values)
        size = np.fromiter(map(len, values), np.int64, len(values))
        least = MARGIN * np.maximum(1, (CERTAIN + 1) / (size + 1))
        # No likelihood is above zero, so a run that is ordinary enough needs no automaton.
        left = np.flatnonzero(-plain >= least)
        if not len(left):
            return out
        text = np.frombuffer("".join([values[i] for i in left.tolist()]).encode("ascii"), np.uint8)
        starts = np.concatenate(([0], np.cumsum(size[left])[:-1]))
        for a in self.automata:
            # Nor does a run need one that would fail if each character were as likely as in any state.
            most = (np.add.reduceat(a.best[text], starts) + a.best[0]) / (size[left] + 1) + 1e-9
            for i in left[(most >= a.floor) & (most - plain[left] >= least[left])].tolist():
                if not out[i]:
                    own = a.likelihood(values[i])
                    out[i] = own >= a.floor and own - plain[i] >= least[i]
        return out

    def found(self, texts: list[str], runs: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Runs of each text that are secrets, or the parts that are of those that are not."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.automata:
            return spans
        whole = [(i, s, e) for i, some in enumerate(runs) for s, e in some]
        values = [texts[i][s:e] for i, s, e in whole]
        parts, inner = [], []
        for place, value, secret in zip(whole, values, self.secrets(values)):
            i, s, _ = place
            if secret:
                spans[i].append(place[1:])
            elif "." in value or "/" in value or "=" in value:
                bare = value.strip(SEPARATORS)
                if "." in bare or "/" in bare or "=" in bare:
                    for m in PART.finditer(value):
                        parts.append((i, s + m.start(), s + m.end()))
                        inner.append(m[0])
                elif len(bare) >= LEAST_VALUE:
                    at = s + value.index(bare)
                    parts.append((i, at, at + len(bare)))
                    inner.append(bare)
        for (i, s, e), secret in zip(parts, self.secrets(inner)):
            if secret:
                spans[i].append((s, e))
        return spans


# --- on tables ------------------------------------------------------------------------


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, value and n: labelled values of kinds 0 to 2, character pairs of other runs as 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for part in pieces(x.as_py() or "" for x in batch.column(0)):
                runs = []
                for t in part:
                    spans, values, others = base_spans(t)
                    found.update((k, v) for (_, k, _), v in zip(spans, values))
                    runs += [t[s:e] for s, e in others]
                found.update({(3, p): n for p, n in pair_counts(runs)})
            rows = [(k, v, n) for (k, v), n in found.items()]
            kinds, values, numbers = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(numbers, pa.int64())],
                names=["kind", "value", "n"],
            )

    found = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "kind int, value string, n long")
    return found.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def formats(docs: DataFrame, text: str = "text") -> Formats:
    """Learned on the driver, from bounded samples of distinct labelled values by hash
    and from the pair counts of all other runs, at most 70 times 70."""
    found = written(counts(docs, text), "secret-labels")
    automata = []
    for kind in range(3):
        sample = (
            found.where(F.col("kind") == kind)
            .orderBy(F.xxhash64("value"), "value").limit(SAMPLE).select("value").collect()
        )
        if sample:
            automata.append(learned(sorted(r[0] for r in sample)))
    pairs: dict[str, dict[str, int]] = defaultdict(dict)
    for r in found.where("kind = 3").select("value", "n").collect():
        pairs[r.value[0]][r.value[1]] = r.n
    return Formats(automata, Ordinary(dict(pairs)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    Texts are read twice: to learn the formats, and to score.
    """
    model = formats(docs, text)
    narrow = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = narrow.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in pieces(x.as_py() or "" for x in batch.column(1)):
                based = [base_spans(t) for t in texts]
                for (base, _, _), extra in zip(based, model.found(texts, [runs for _, _, runs in based])):
                    more = [(s, 3, e) for s, e in extra]
                    kinds = Counter(k for _, k, _ in base)
                    out.append((
                        kinds[0], kinds[1], kinds[2],
                        hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more),
                    ))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 *[pa.array(c, pa.string()) for c in columns[3:]]],
                names=["_key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    scored = narrow.mapInArrow(
        run, f"_key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return scored.withColumnRenamed("_key", key)


MASK = "[SECRET]"


def masked(texts: list[str], model: Formats) -> list[str]:
    """Each text with every span, overlapping ones as one, replaced by ``MASK``."""
    out = []
    for part in pieces(texts):
        based = [base_spans(t) for t in part]
        out += [
            _masked(t, sorted([(s, e) for s, _, e in base] + extra))
            for t, (base, _, _), extra in zip(part, based, model.found(part, [runs for _, _, runs in based]))
        ]
    return out


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets masked; ``size`` follows, if there is one.

    Null texts stay null. Texts are read twice: to learn the formats, and to mask.
    """
    model = formats(docs, text)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        new = masked([t or "" for t in texts], model)
        return pd.Series([None if t is None else n for t, n in zip(texts, new)], dtype=object)

    rows = packed(docs).withColumn("_new", mask(F.col(f"_row.`{text}`")))
    columns = []
    for f in docs.schema.fields:
        own = F.col(f"_row.`{f.name}`")
        if f.name == text:
            own = F.col("_new")
        elif f.name == size:
            changed = ~F.col("_new").eqNullSafe(F.col(f"_row.`{text}`"))
            own = F.when(changed, F.length("_new").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return rows.select(*columns)
