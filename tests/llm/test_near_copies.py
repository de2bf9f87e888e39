from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from edge_data import edge_rows, rows_of
import corpus_pipeline
from tidemark.llm import near_copies, simhash


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    """Smallest key of every group, by comparing all sets with all."""
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 10 >= 8 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for key, text in rows:
        group = label[sets.index(plain_set(text))]
        least[group] = min((k for k in (least.get(group), key) if k is not None), default=None)
    return Counter(least.values())


def edited(rng, words, every):
    return [f"new{rng.randrange(10**6)}" if rng.random() < 1 / every else w for w in words]


def near_rows(seed=4):
    """Groups of edited texts, some of which only chain to one another."""
    rng, rows = random.Random(seed), []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(8):
            rows.append((len(rows), " ".join(edited(rng, words, 60))))
        for _ in range(4):
            rows.append((len(rows), " ".join(words := edited(rng, words, 70))))
    rng.shuffle(rows)
    return rows


def kept(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter(r.doc_id for r in near_copies.deduplicate(docs, **more).collect())


def test_the_stage_finds_ordinary_near_copies(spark):
    rows = near_rows()
    stage = dict(corpus_pipeline.STAGES)["near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(r.doc_id for r in stage.collect()) == plain_groups(rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SIMILARITY, 3))
    rows = near_rows(9)
    assert kept(spark, rows) == plain_groups(rows)


def test_edges(spark, edges, nothing):
    stayed = near_copies.deduplicate(edges)
    assert stayed.columns == edges.columns
    assert Counter(r.doc_id for r in stayed.collect()) == plain_groups([r[:2] for r in edge_rows()])
    assert rows_of(near_copies.deduplicate(nothing)) == []


def test_width_and_similarity_are_arguments(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")]
    assert kept(spark, rows) == Counter([1, 2])  # 5 of 7
    assert kept(spark, rows, similarity=0.7) == Counter([1])
    assert kept(spark, rows, shingle=1) == Counter([1])  # 9 of 11


def test_joins_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(40)]
    label = np.arange(40)
    for i, j in near_copies.joins(sets, np.arange(40)):
        label[label == label[j]] = label[i]
    for i in range(40):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                assert label[i] == label[j]


def test_pairs_come_through_the_bit_planes(spark, monkeypatch):
    """The planes compare the fingerprints, and what they find joins most copies by itself."""
    rows = near_rows(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = docs.select(near_copies._sketch(5, docs.text).alias("s")).select("s.*").dropDuplicates(["fp"])
    wide = prints.selectExpr("0L as bucket", "fp", "print", "2L as n")
    found = near_copies.close(prints, wide, 256).collect()
    sets = {near_copies._digest(near_copies.shingles(t)): set(near_copies.shingles(t).tolist()) for _, t in rows}
    assert all(r.a != r.b for r in found)
    near = [(r.a, r.b) for r in found if len(sets[r.a] & sets[r.b]) >= 0.8 * len(sets[r.a] | sets[r.b])]
    label = {s: s for s in sets}
    for a, b in near:
        label = {s: label[a] if v == label[b] else v for s, v in label.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 100
    assert sum(label[a] == label[b] for a, b in pairs) >= 0.9 * len(pairs)
    # And the stage asks them.
    asked, plain = [], near_copies.close
    monkeypatch.setattr(near_copies, "close", lambda *given: asked.append(given) or plain(*given))
    assert kept(spark, rows) == plain_groups(rows) and asked


def test_planes_count_up_to_any_radius():
    rng = np.random.default_rng(3)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 12)).astype(np.uint64), axis=1)
    prints = (rng.integers(0, 2**63, 1, np.uint64) ^ flips).view(np.int64)
    for radius in (0, 1, 2, 3, 6, 9, 12, 15):
        a, b = simhash.close_pairs(prints, np.zeros(300, np.int64), radius)
        plain = {(i, j) for i in range(300) for j in range(i + 1, 300) if ((int(prints[i]) ^ int(prints[j])) & (2**64 - 1)).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == plain


def test_each_text_is_printed_once_for_its_set_and_once_for_the_verdict(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counting(width, text):
        @F.pandas_udf("string")
        def print_(texts: pd.Series) -> pd.Series:
            met.add(len(texts))
            return pd.Series([near_copies._digest(near_copies.shingles(t, width)) for t in texts], dtype=object)

        return print_(text)

    rows = near_rows()
    monkeypatch.setattr(near_copies, "_print", counting)
    assert kept(spark, rows) == plain_groups(rows)
    assert met.value == 2 * len(rows)
