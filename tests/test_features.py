from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.classes import UnknownColumnError
from tidemark.operators import clean, features, ordered

COLUMNS = (
    "season string, code string, position string, round string, minutes string, "
    "total_points string, value string, fixture string"
)


def panel(spark, points, season="2024-25", code="999", position="MID"):
    rows = [
        (season, code, position, str(i + 1), "90", None if p is None else str(p), "50", str(i))
        for i, p in enumerate(points)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def column(df, name):
    return [r[name] for r in df.orderBy("round", "fixture").collect()]


def test_frames_end_before_the_current_row(spark):
    built = features.build(panel(spark, [1, 2, 3, 4, 5, 6, 7])).persist()
    assert column(built, "total_points_mean5") == [None, 1, 1.5, 2, 2.5, 3, 4]
    assert column(built, "total_points_todate_sum") == [None, 1, 3, 6, 10, 15, 21]
    assert column(built, "minutes_mean3") == [None] + [90] * 6
    assert column(built, "appearances_todate") == [None, 1, 2, 3, 4, 5, 6]
    assert column(built, "points_per90_todate")[:3] == [None, 1.0, 1.5]


def test_nulls_are_skipped_in_means_and_break_the_running_sum_once(spark):
    built = features.add_features(
        clean.prepare(panel(spark, [4, None, 2, "n/a", 6])),
        [features.lagged("total_points", 5), features.expanding("total_points"),
         features.expanding("total_points", "count")],
    ).persist()
    assert column(built, "total_points_mean5") == [None, 4, 4, 3, 3]
    assert column(built, "total_points_todate_sum") == [None, 4, None, 6, None]
    assert column(built, "total_points_todate_count") == [0, 1, 1, 2, 2]


def test_seasons_and_entities_do_not_mix(spark):
    both = panel(spark, [9, 9]).union(panel(spark, [1, 1], season="2025-26")).union(
        panel(spark, [5, 5], code="7")
    )
    built = features.build(both).where(F.col("round") == 2)
    got = {(r.season, r.code): r.total_points_mean5 for r in built.collect()}
    assert got == {("2024-25", "999"): 9, ("2025-26", "999"): 1, ("2024-25", "7"): 5}


def test_what_may_be_lagged():
    with pytest.raises(ValueError, match="before the deadline"):
        features.lagged("value", 5)
    with pytest.raises(ValueError):
        features.lagged("name", 5)
    with pytest.raises(UnknownColumnError):
        features.lagged("no_such_stat", 5)
    with pytest.raises(UnknownColumnError):
        features.expanding("no_such_stat")
    with pytest.raises(KeyError):
        features.lagged("minutes", 5, "median")
    assert features.expanding("value").name == "value_todate_sum"


def test_cleaning(spark):
    mixed = panel(spark, [1], position="AM").union(panel(spark, [1], position="GKP")).union(
        panel(spark, [1], position=None)
    )
    assert [r.position for r in clean.prepare(mixed).collect()] == ["GK"]
    assert clean.prepare(panel(spark, [1]).drop("code")).count() == 0
    assert clean.prepare(panel(spark, [1]).drop("position")).count() == 1
    report = clean.dropped_by_season(mixed).first()
    assert (report.rows, report.no_group, report.dropped_group) == (3, 1, 1)


@pytest.mark.parametrize(
    ("text", "number"),
    [("6.0", 6.0), (" 6 ", 6.0), ("6d", None), ("6.F", None), ("x", None), ("", None), ("1e3", 1000.0)],
)
def test_tolerant_numbers(spark, text, number):
    row = spark.createDataFrame([(text,)], "t string").select(
        clean.tolerant_double("t").alias("d"), clean.tolerant_long("t").alias("n")
    ).first()
    assert row.d == number
    assert row.n == (int(text) if text.strip().isdigit() else None)


def test_a_later_outcome_never_moves_an_earlier_feature(spark):
    before = features.build(panel(spark, [1, 2, 3, 4, 5, 6]))
    after = features.build(panel(spark, [1, 2, 3, 400, 500, 600]))
    names = [f.name for f in features.standard_features()] + ["points_per90_todate"]
    rows = [
        [tuple(r[n] for n in names) for r in df.orderBy("round").collect()] for df in (before, after)
    ]
    assert rows[0][:4] == rows[1][:4]
    assert rows[0][4] != rows[1][4]


def test_strict_frames_step_over_whole_periods(spark):
    rows = [
        ("s", "1", "MID", r, "90", p, "50", f)
        for r, p, f in [("1", "2", "a"), ("2", "3", "b"), ("2", "9", "c"), ("3", "1", "d")]
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    loose = column(features.build(frame), "total_points_todate_sum")
    strict = column(features.build(frame, strict=True), "total_points_todate_sum")
    assert loose == [None, 2, 5, 14]
    assert strict == [None, 2, 2, 14]


def test_chunked_plan_equals_windows_with_one_very_long_season(spark, small_groups, monkeypatch):
    rng = random.Random(5)
    rows = []
    for code, length in (("hot", 900), ("b", 40), ("c", 3)):
        for i in range(length):
            points = None if rng.random() < 0.1 else str(rng.randint(-2, 15))
            rows.append(("s", code, "MID", str(i // 2), str(rng.choice([0, 30, 90])), points, "5",
                         f"{i:05d}"))
    frame = spark.createDataFrame(rows, COLUMNS)
    split = features.build(frame).persist()
    monkeypatch.setattr(ordered, "WINDOW_GROUP_ROWS", 10**6)
    whole = features.build(frame)
    names = ["code", "fixture", *[f.name for f in features.standard_features()]]
    assert split.count() == len(rows)
    assert sorted(map(repr, split.select(*names).collect())) == sorted(
        map(repr, whole.select(*names).collect())
    )
