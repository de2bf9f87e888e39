from __future__ import annotations

import math
import random

import pytest

from edge_data import rows_of
from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, pack int, ids string, _d double"


def plain(rows, k=10, every=100):
    whole = []
    for key, v in rows:
        if key is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        whole.append((key, [math.floor(1024 * c) for c in v]))
    out = []
    for q, x in whole:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), key) for key, y in whole if key != q)[:k]
            out += [(q, i + 1, key, -s) for i, (s, key) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "i", 0.5) for k, v in rows], SCHEMA)


def ours(spark, rows, **options):
    import numpy as np

    as_float = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows]
    return sorted(rows_of(topk.top_k(frame(spark, rows), **options))), as_float


def test_whole_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    expected = plain([(r.vec_id, r.embedding) for r in given.collect()])
    assert sorted(rows_of(topk.top_k(given))) == expected


@pytest.mark.parametrize("annulus", [7, 2048])
def test_edges(spark, annulus):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 9 == 0 else 1) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.25, 0.5, -0.5, 1.0]) for i in range(300, 360)]  # ties
    rows += [(400, None), (401, []), (402, [None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 4),
             (404, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (405, [0.0] * 4)]
    found, exact = ours(spark, rows, annulus=annulus, every=20)
    assert found == plain(exact, every=20)


def test_prunes_what_bounds_exclude(spark):
    """Clusters far apart: a query's pack is paired with few annuli of others."""
    rng = random.Random(2)
    rows = [(i, [100.0 * (j == i % 4) + rng.gauss(0, 0.1) for j in range(4)]) for i in range(800)]
    found, exact = ours(spark, rows, annulus=20, every=20)
    assert found == plain(exact, every=20)


def test_fewer_rows_than_k(spark):
    found, exact = ours(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [-1.0, 0.0])])
    assert found == plain(exact)


def test_empty(spark):
    assert rows_of(topk.top_k(frame(spark, []))) == []
