from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, ranks


def skewed(spark, n=1200):
    """One group holds most rows, and one value a third of them."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        group = "big" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        value = 0.0 if rng.random() < 0.34 else rng.choice([None, -0.0, float(rng.randint(1, 300))])
        rows.append(("s", group, i, value))
    return spark.createDataFrame(rows, "season string, round string, code int, value double")


def expected_ranks(df):
    frame = df.toPandas()
    frame["rank"] = frame.groupby("round", dropna=False)["value"].rank("average")
    return {r.code: (None if pd.isna(r.rank_) else r.rank_)
            for r in frame.rename(columns={"rank": "rank_"}).itertuples()}


def test_average_rank_in_both_plans(spark, small_groups, monkeypatch):
    df = skewed(spark).persist()
    expected = expected_ranks(df)
    split = ranks.average_rank(df, ["season", "round"], "value", "r")
    assert {r.code: r.r for r in split.collect()} == expected
    monkeypatch.setattr(ordered, "WINDOW_GROUP_ROWS", 10**6)
    whole = ranks.average_rank(df, ["season", "round"], "value", "r")
    assert {r.code: r.r for r in whole.collect()} == expected


def test_bucket_is_held_to_the_ends_and_null_without_price(spark):
    rows = [("s", 1.0, str(i), float(i) if i else None) for i in range(25)]
    df = spark.createDataFrame(rows, "season string, round double, code string, value double")
    got = {r.code: r.price_bucket for r in ranks.price_bucket(df).collect()}
    # The row without a price has no bucket but counts in the period's length.
    assert got["0"] is None
    assert got["1"] == 1 and got["24"] == 10
    assert got["5"] == 2 and got["6"] == 3


def test_output_rank_in_both_plans(spark, small_groups, monkeypatch):
    df = skewed(spark).withColumnRenamed("value", "prediction").persist()
    split = ranks.output_rank(df, ["round"])
    monkeypatch.setattr(ordered, "WINDOW_GROUP_ROWS", 10**6)
    whole = ranks.output_rank(df, ["round"])
    def pick(d):
        return {r.code: r["rank"] for r in d.collect()}
    assert pick(split) == pick(whole)


def test_group_length_in_both_plans(spark, small_groups):
    df = skewed(spark)
    sizes = df.toPandas().fillna({"round": "none"}).groupby("round").size().to_dict()
    got = ranks.group_length(df, ["round"], "n").select("round", "n").distinct().collect()
    assert {r["round"] or "none": r.n for r in got} == sizes


def test_top_k_keeps_k_rows_per_group_before_the_shuffle(spark):
    df = skewed(spark)
    top = ranks.top_k(df, ["round"], "value", "code", 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("round").count().agg(F.max("count")).first()[0] == 3


AWKWARD = [1.0, float("nan"), 3.0, None, 0.0, -0.0, 3.0, float("inf"), -float("inf"), None]


def _awkward(spark, rows=240):
    """Two groups, one with over 95 % of the rows; NaN, both zeros and nulls among ties."""
    data = [(1 if i % 40 else 2, f"e{i:04d}", AWKWARD[i % 10] if i % 3 else float(i)) for i in range(rows)]
    return spark.createDataFrame(data, "g int, code string, prediction double")


@pytest.mark.parametrize("given", [None, 240])
def test_plans_agree_on_nan_zeros_and_nulls(spark, monkeypatch, given):
    monkeypatch.setattr(ordered, "BUCKETS_PER_GROUP", 16)
    df = _awkward(spark)
    for rank in (
        lambda plan: ranks.output_rank(df, ["g"], group_rows=given, plan=plan),
        lambda plan: ranks.average_rank(df, ["g"], "prediction", "rank", group_rows=given, plan=plan),
        lambda plan: ranks.group_length(df, ["g"], "rank", group_rows=given, plan=plan),
    ):
        window, split = ({r.code: r["rank"] for r in rank(plan).collect()} for plan in (ordered.WINDOW, ordered.SPLIT))
        assert window == split


def test_a_bound_below_the_truth_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS_PER_GROUP", 16)
    df = spark.range(4000).selectExpr("1 AS g", "id AS code", "cast(id as double) AS prediction")
    with pytest.raises(ValueError, match="below its true size"):
        ranks.output_rank(df, ["g"], group_rows=10, plan=ordered.SPLIT)


def test_buckets_stay_even_beyond_the_aim(spark):
    """Very many split points in one group: the search reaches all of them."""
    df = spark.range(30_000).selectExpr("1 AS g", "id")
    split = ordered.with_bucket(df, ["g"], [df.id], 10)
    sizes = [r["count"] for r in split.groupBy("_bucket").count().collect()]
    assert len(sizes) > 2500 and max(sizes) < 20 * (sum(sizes) / len(sizes))
