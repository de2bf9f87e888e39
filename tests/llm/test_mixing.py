from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pandas as pd

from edge_data import edge_rows, rows_of
from tidemark.llm import mixing


def documents(spark, sizes, length=50, seed=1):
    rng = random.Random(seed)
    rows = [(f"{s}{i}", "x" * rng.randrange(2 * length), s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def test_less_than_one_block_off(spark):
    """While every source lasts, its blocks stay within one of its weight at every slot."""
    docs = documents(spark, {"a": 700, "b": 300, "c": 60, "d": 5})
    rows = mixing.schedule(docs, {"a": 500, "b": 300, "c": 190, "d": 10}, block=100, period=64).collect()
    share = {r.source: r.share for r in rows}
    assert sum(share.values()) == 64 and min(share.values()) >= 1
    slots = mixing.template(
        spark.createDataFrame([("=" + s, 64, n) for s, n in share.items()], "_source string, _period long, _share long")
    ).collect()
    taken = {slot: r._source[1:] for r in slots for slot in r._slots}
    assert sorted(taken) == list(range(64))
    had = Counter()
    for slot in range(64):
        had[taken[slot]] += 1
        for s, n in share.items():
            assert abs(had[s] - Fraction(n * (slot + 1), 64)) < 1
    for r in rows:  # every block is in a slot of its source, the right one in order
        of = sorted(s for s, x in taken.items() if x == r.source)
        assert r.slot == r.block // r.share * 64 + of[r.block % r.share]


def test_places_do_not_overlap(spark):
    rows = mixing.schedule(documents(spark, {"a": 3000, "b": 10}), block=1000, period=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.start, r.units, r.block))
    for places in by.values():
        at = 0
        for start, units, block in sorted(places):
            assert start == at and block == start // 1000
            at += units


def test_edges_equal_sql(spark, edges):
    rows = pd.DataFrame(edge_rows(), columns=["doc_id", "text", "lang", "source", "n_chars"])
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    db = duckdb.connect()
    db.register("documents", rows)
    theirs = Counter(db.execute(mixing.sql()).fetchall())
    assert Counter(rows_of(mixing.schedule(edges))) == theirs


def test_interleaved_rows_are_whole_and_in_order(spark, edges, tmp_path):
    mixed = mixing.interleave(edges, block=5000)
    assert mixed.columns == edges.columns
    assert Counter(map(repr, rows_of(mixed))) == Counter(map(repr, rows_of(edges)))
    at = {r.doc_id: (r.slot, r.start) for r in mixing.schedule(edges, block=5000).collect()}
    keys = [r.doc_id for r in mixed.collect() if r.doc_id is not None and r.doc_id not in (3, 60)]
    assert keys == sorted(keys, key=at.get)


def test_empty(nothing):
    assert rows_of(mixing.schedule(nothing)) == []
    assert rows_of(mixing.interleave(nothing)) == []
