from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, shrinkage
from tidemark.plans import backtest

LIMITS = shrinkage.FitLimits(buckets=4, min_rows=40, min_entity_periods=3, min_entities=4)


def frame(spark, entities=14, periods=11, seasons=("a", "b"), extra=0):
    rng = random.Random(1)
    rows = []
    for s in seasons:
        for e in range(entities):
            level = rng.uniform(0, 8)
            for r in range(1, periods + 1):
                for d in range(2 if rng.random() < 0.1 else 1):
                    if rng.random() < 0.15:
                        continue
                    y = None if rng.random() < 0.05 else float(round(rng.gauss(level, 3)))
                    price = None if rng.random() < 0.05 else float(rng.randint(40, 60))
                    rows.append((s, float(r), f"{e:02d}", f"n{e}", "GDMF"[e % 4], y, 90.0, price,
                                 f"{r}-{d}"))
    columns = ("season string, round double, code string, name string, position string, "
               "total_points double, minutes double, value double, fixture string")
    return features.build(spark.createDataFrame(rows, columns)).persist()


def bucketed(part):
    rank = part.groupby(["season", "round"])["value"].rank()
    size = part.groupby(["season", "round"])["value"].transform("size")
    return np.ceil(rank / size * LIMITS.buckets).clip(1, LIMITS.buckets)


def naive_fit(history):
    usable = history.dropna(subset=["total_points", "value", "position"]).copy()
    grand = usable.total_points.mean() if len(usable) else 0.0
    if len(usable) < LIMITS.min_rows:
        return {}, LIMITS.fallback, grand
    usable["b"] = bucketed(usable)
    table = usable.groupby(["position", "b"]).total_points.mean().to_dict()
    m = usable.groupby(["season", "code"]).total_points.agg(["mean", "var", "size"])
    m = m[(m["size"] >= LIMITS.min_entity_periods)].dropna(subset=["var"])
    k = LIMITS.fallback
    if len(m) > LIMITS.min_entities:
        within = m["var"].mean()
        between = m["mean"].var() - within / m["size"].mean()
        if between > 1e-6 and within > 0:
            k = within / between
    return table, k, grand


def naive_predict(fitted, target):
    table, k, grand = fitted
    out = {}
    for row, b in zip(target.itertuples(), bucketed(target)):
        prior = table.get((row.position, b), grand)
        earned = 0.0 if pd.isna(row.total_points_todate_sum) else row.total_points_todate_sum
        out[(row.season, row.round, row.code, row.fixture)] = (earned + k * prior) / (
            max(row.round - 1, 0) + k
        )
    return out


def keyed(df):
    return {(r.season, r.round, r.code, r.fixture): r.prediction for r in df.collect()}


def test_refit_at_every_cutoff_equals_the_loop(spark):
    df = frame(spark)
    rows = df.toPandas()
    expected, strengths = {}, set()
    for (s, r), target in rows[rows["round"] >= 4].groupby(["season", "round"]):
        fitted = naive_fit(rows[(rows.season == s) & (rows["round"] < r)])
        strengths.add(round(fitted[1], 6))
        expected |= naive_predict(fitted, target)
    got = keyed(shrinkage.predict_walking(df, limits=LIMITS, first_period=4))
    assert len(strengths) > 3, "the fixture must exercise fitted strengths"
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[key], expected[key], rel_tol=1e-9) for key in got)


def test_fixed_prior_equals_the_definition(spark):
    df = frame(spark)
    past, now = df.where("season = 'a'"), df.where("season = 'b'")
    fitted = naive_fit(past.toPandas())
    prior = shrinkage.fit(past, limits=LIMITS)
    row = prior.scalars.first()
    assert (row.k, row.grand_mean) == (pytest.approx(fitted[1]), pytest.approx(fitted[2]))
    assert "strength" in prior.describe()
    expected = naive_predict(fitted, now.toPandas())
    got = keyed(shrinkage.predict(prior, now))
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[key], expected[key], rel_tol=1e-9) for key in got)


def test_too_little_history_shrinks_to_the_overall_mean(spark):
    df = frame(spark, entities=3, periods=4, seasons=("a",))
    prior = shrinkage.fit(df)
    assert prior.table.count() == 0
    assert prior.scalars.first().k == 10.0
    empty = shrinkage.fit(df.where("season = 'none'"))
    assert tuple(empty.scalars.first()) == (10.0, 0.0)


def test_same_results_with_split_plans(spark, small_groups):
    df = frame(spark)
    split = keyed(shrinkage.predict_walking(df, limits=LIMITS, first_period=4))
    whole = keyed(shrinkage.predict_walking(df, limits=LIMITS, first_period=4, group_rows=1))
    assert split.keys() == whole.keys()
    assert all(math.isclose(split[k], whole[k], rel_tol=1e-9) for k in split)


def test_custom_predictor_sees_only_earlier_rows(spark):
    df = frame(spark)
    rows = df.toPandas()

    def mean_so_far(history, target):
        means = history.groupBy("season", "cutoff").agg(F.avg("total_points").alias("prediction"))
        return target.join(means, ["season", "cutoff"], "left")

    got = backtest.walk_forward(df, mean_so_far, first_period=4)
    per_period = {(r.season, r["round"]): r.prediction for r in got.collect()}
    assert got.count() == int((rows["round"] >= 4).sum())
    for (s, r), value in per_period.items():
        past = rows[(rows.season == s) & (rows["round"] < r)]
        assert value == pytest.approx(past.total_points.mean())


def test_backtest_refuses_empty_targets_and_unkeyed_predictions(spark):
    df = frame(spark, entities=3, periods=3)
    with pytest.raises(ValueError, match="nothing to predict"):
        backtest.walk_forward(df, "rolling_mean5", first_period=20)
    with pytest.raises(ValueError, match="lacks code"):
        backtest.walk_forward(df, lambda h, t: t.drop("code").withColumn("prediction", F.lit(1.0)),
                              first_period=2)
    with pytest.raises(KeyError, match="no rule named"):
        backtest.walk_forward(df, "oracle", first_period=2)
