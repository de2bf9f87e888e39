from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ordered

SCHEMA = (
    "season string, round int, position string, code string, prediction double, actual double, "
    "minutes double"
)


def results(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_group_without_spread_is_left_out(spark):
    flat = [("s", 1, "MID", str(i), 0.1, float(i), 90.0) for i in range(6)]
    perfect = [("s", 2, "MID", str(i), i / 3.0, float(i), 90.0) for i in range(6)]
    row = metrics.rank_correlation(results(spark, flat + perfect)).first()
    assert row.rank_corr == 1.0
    only_flat = metrics.rank_correlation(results(spark, flat)).first()
    assert only_flat.rank_corr is None


def test_small_groups_and_played_rows(spark):
    rows = [("s", 1, "MID", str(i), float(i), float(-i), 90.0 if i < 5 else 0.0) for i in range(7)]
    few = [("s", 1, "GK", str(i), float(i), float(i), 90.0) for i in range(4)]
    each = {r.position: r for r in metrics.group_correlations(results(spark, rows + few)).collect()}
    assert (each["MID"].n, each["MID"].n_played, each["MID"].rho_played) == (7, 5, -1.0)
    row = metrics.rank_correlation(results(spark, rows + few)).first()
    assert (row.rank_corr, row.rank_corr_played) == (-1.0, -1.0)


def noisy(spark, n=1500):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        pred = 0.0 if rng.random() < 0.4 else rng.choice([None, rng.random(), float(rng.randint(0, 9))])
        rows.append(("s", 1 if rng.random() < 0.7 else rng.randint(2, 5), rng.choice(["G", "D", None]), str(i),
                     pred, float(rng.randint(-1, 12)), rng.choice([0.0, 45.0, None])))
    return results(spark, rows)


def pandas_rho(frame):
    out = {}
    kept = frame.dropna(subset=["prediction", "actual"])
    for key, g in kept.fillna({"position": "?"}).groupby(["round", "position"]):
        out[key] = g["prediction"].rank().corr(g["actual"].rank())
    return out


def test_both_correlation_plans_equal_pandas(spark, small_groups, monkeypatch):
    df = noisy(spark).persist()
    frame = df.toPandas()
    every, played = pandas_rho(frame), pandas_rho(frame[frame.minutes > 0])
    def check(table):
        for r in table.collect():
            key = (r["round"], r.position or "?")
            assert r.rho == pytest.approx(every[key])
            assert r.rho_played == pytest.approx(played[key])
    check(metrics.group_correlations(df))
    monkeypatch.setattr(ordered, "WINDOW_GROUP_ROWS", 10**6)
    check(metrics.group_correlations(df))


def test_overlap_counts_entities_in_both_lists(spark):
    rows = [("s", 1, "M", f"{i:02d}", float(i), float(i if i < 6 else -i), 90.0) for i in range(8)]
    thin = [("s", 2, "M", f"{i:02d}", float(i), float(i), 90.0) for i in range(3)]
    row = metrics.top_overlap(results(spark, rows + thin), k=2).first()
    # Highest predicted are 7 and 6, highest actual 5 and 4; period 2 has too few rows.
    assert row.top2_overlap == 0.0
    agree = [("s", 1, "M", f"{i:02d}", float(i), float(i), 90.0) for i in range(8)]
    assert metrics.top_overlap(results(spark, agree), k=2).first().top2_overlap == 1.0


def test_score_card(spark):
    rows = [("s", 1, "M", "a", 3.0, 5.0, 90.0), ("s", 1, "M", "b", 1.0, 0.0, 0.0),
            ("s", 2, "M", "a", None, 1.0, 90.0)]
    card = metrics.score(results(spark, rows)).first()
    assert (card.periods, card.rows, card.mae, card.mae_played) == (2, 3, 1.5, 2.0)
    assert card.rank_corr is None and card.top20_overlap is None
    ranking = metrics.score(results(spark, rows), on_scale=False).first()
    assert ranking.mae is None and ranking.mae_played is None
    by = results(spark, rows).withColumn("m", F.col("code"))
    assert {r.m: r.rows for r in metrics.score(by, by=["m"]).collect()} == {"a": 2, "b": 1}
