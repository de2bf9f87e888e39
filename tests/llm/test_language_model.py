from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from edge_data import edge_rows, rows_of
from tidemark.llm import language_model as lm


def plain(rows):
    """Base columns of every row."""
    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for blank in "\t\n\v\f\r":
            low = low.replace(blank, " ")
        return [w for w in low.split(" ") if w] + ["\n"]

    out_ = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    counts = Counter()
    for (_, t), o in zip(rows, out_):
        if not o:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    result = []
    for (k, t), o in zip(rows, out_):
        own = tokens(t)
        result.append((k, o, len(own), sum(w in counts for w in own), n,
                       sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return result


def same(ours, theirs):
    order = lambda r: (repr(r[:5]), r[5])
    ours, theirs = sorted(ours, key=order), sorted(theirs, key=order)
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]
    assert [r[5] for r in ours] == pytest.approx([r[5] for r in theirs], rel=1e-9)


@pytest.mark.parametrize("known", [5, 200_000])
def test_edges_equal_brute_force(edges, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    same([r[:6] for r in rows_of(lm.score(edges))], plain([r[:2] for r in edge_rows()]))


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(docs).collect()
    same([tuple(r)[:6] for r in rows], plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    for held_out in (True, False):
        own = [r for r in rows if r.held_out == held_out]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_probabilities_sum_to_one():
    words = lm.Vocabulary([b"a", b"b"], [3, 2], {}, 5, 2)
    model = lm.LogBilinear(words.mass)
    rng = np.random.default_rng(1)
    model.load(rng.normal(0, 0.5, len(model.flat())))
    a, b, z = model.log10_tables()
    for u, v in [(0, 1), (lm.START, lm.START), (5, 1000)]:
        assert (10.0 ** (a[u] + b[v] - z[u, v])).sum() == pytest.approx(1)


def test_training_learns_a_rule():
    """After class 1 comes 2, after 2 comes 1: the model becomes sure of it."""
    mass = np.ones(lm.CLASSES)
    mass[1:3] += 10_000
    model = lm.LogBilinear(mass)
    trainer = lm.Trainer(model, 1)
    w = np.tile([1, 2], 4096)
    u, v = np.roll(w, 2), np.roll(w, 1)
    for _ in range(300):
        trainer.step(u, v, w)
    a, b, z = model.log10_tables()
    assert a[2, 2] + b[1, 2] - z[2, 1] > math.log10(0.8)


def test_contexts_stop_at_texts():
    two, one = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([3, 2]))
    assert one.tolist() == [lm.START, 1, 2, lm.START, 4]
    assert two.tolist() == [lm.START, lm.START, 1, lm.START, lm.START]


def test_empty(nothing):
    assert rows_of(lm.score(nothing)) == []
