from __future__ import annotations

import math
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.plans import backtest, predictors
from tidemark.spec import PanelSpec

# Workers do not import test modules, so the predictors below are sent as code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPEC = PanelSpec()
SCHEMA = "season string, round int, code string, name string, position string, total_points double, minutes double, fixture int, prediction double, state string"


def rows_of_panel(periods=11, seed=1):
    """Two seasons and a null one; one entity has a third of all rows; gaps and nulls."""
    rng = random.Random(seed)
    rows = []
    for season in ("a", "b", None):
        for period in range(1, periods + 1):
            if season == "b" and period in (3, 7):
                continue
            for e in range(8):
                for fixture in range(4 if e == 0 else 1):
                    points = None if rng.random() < 0.05 else float(rng.randrange(12))
                    rows.append((season, period, f"e{e}", f"name {e}", [None, "x", "y"][e % 3], points, 90.0, fixture, 0.0, "s"))
    rows.append(("a", None, "e1", "name", "x", 100.0, 1.0, 0, 0.0, "s"))
    return rows + [rows[0], rows[0]]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(rows_of_panel(), SCHEMA)


def expected(rows, first, learn):
    """One call per season and cutoff with the whole history, as a loop would do it."""
    out = []
    for row in rows:
        season, period, code, _, position, points, minutes, fixture, *_ = row
        if period is not None and period >= first:
            history = [r for r in rows if r[0] == season and r[1] is not None and r[1] < period]
            out.append((season, period, code, position, learn(history, position), points))
    return sorted(out, key=repr)


def mean_of_group(history, position):
    known = [r[5] for r in history if r[4] == position and r[5] is not None]
    return sum(known) / len(known) if known else None


def got(df):
    return sorted([(r.season, r["round"], r.code, r.position, r.prediction, r.actual) for r in df.collect()], key=repr)


def close(left, right):
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a[:4] + a[5:] == b[:4] + b[5:]
        assert a[4] == b[4] or math.isclose(a[4], b[4], rel_tol=1e-9), (a, b)


class Mean(predictors.MergeablePredictor):
    history = ("position", "total_points")
    target = ("position",)

    def zero(self):
        return {}

    def add(self, state, rows):
        for position, points in zip(rows["position"], rows["total_points"]):
            if points == points and points is not None:
                total, n = state.get(position, (0.0, 0))
                state[position] = (total + points, n + 1)
        return state

    def merge(self, left, right):
        for position, (total, n) in right.items():
            a, b = left.get(position, (0.0, 0))
            left[position] = (a + total, b + n)
        return left

    def predict(self, state, target):
        return [state[p][0] / state[p][1] if p in state else None for p in target["position"]]


def aggregate_mean():
    return predictors.AggregatePredictor(
        keys=["position"],
        partial={"s": F.sum("total_points"), "n": F.count("total_points")},
        merge={"s": F.sum("s"), "n": F.sum("n")},
        prediction=F.col("s") / F.when(F.col("n") > 0, F.col("n")),
    )


@pytest.mark.parametrize("first", [1, 6])
def test_states_in_python_equal_the_loop(spark, panel, first):
    close(got(backtest.walk_forward(panel, Mean(), first_period=first)), expected(rows_of_panel(), first, mean_of_group))


@pytest.mark.parametrize("first", [1, 6])
def test_aggregates_equal_the_loop(spark, panel, first):
    close(got(backtest.walk_forward(panel, aggregate_mean(), first_period=first)), expected(rows_of_panel(), first, mean_of_group))


def test_small_fan_in_and_many_slots_give_the_same(spark, panel, monkeypatch):
    """A tree of several levels, states handed on early, and a period in several groups."""
    monkeypatch.setattr(predictors, "FAN_IN", 2)
    monkeypatch.setattr(predictors, "TARGET_ROWS", 3)
    many = panel.repartition(13, "code", "fixture")
    close(got(backtest.walk_forward(many, Mean(), first_period=4)), expected(rows_of_panel(), 4, mean_of_group))


def test_function_of_a_history(spark, panel):
    def function(history, target):
        means = history.dropna(subset=["total_points"]).groupby("position", dropna=False)["total_points"].mean()
        named = {p if isinstance(p, str) else None: v for p, v in means.items()}
        return [named.get(p if isinstance(p, str) else None) for p in target["position"]]

    predictor = predictors.HistoryFunction(function, ["position", "total_points"], ["position"])
    close(got(backtest.walk_forward(panel, predictor, first_period=3)), expected(rows_of_panel(), 3, mean_of_group))
    small = predictors.HistoryFunction(function, ["position", "total_points"], ["position"], max_rows=20)
    with pytest.raises(Exception, match="more than 20 rows"):
        backtest.walk_forward(panel, small, first_period=3).collect()


def test_rows_are_copied_once_a_level_not_once_a_cutoff(spark):
    """Per-period states of 64 periods: at most half of the six levels each, where the history
    by cutoff would hold half of all pairs of periods."""
    periods = 64
    frame = spark.range(periods).select(
        F.lit("a").alias("season"), (F.col("id") + 1).cast("int").alias("round"), F.lit("e").alias("code"),
        F.lit("x").alias("position"), F.lit(1.0).alias("total_points"), F.lit(1.0).alias("minutes"))
    numbered = blocks.numbered_periods(frame, SPEC)
    levels = blocks.levels_of(numbered)
    assert levels == 6
    rows = blocks.with_numbers(frame, numbered, SPEC)
    copies = blocks.in_blocks(rows, levels).count()
    assert copies <= periods * levels / 2 + periods
    assert backtest.history_by_cutoff(frame, SPEC, 1).count() == periods * (periods - 1) // 2 > 8 * copies
    asked = blocks.blocks_before(numbered.select(blocks.SEASON, blocks.AT), levels)
    assert asked.groupBy(blocks.AT).count().agg(F.max("count")).first()[0] <= levels
    spans = {}
    for r in asked.collect():
        spans.setdefault(r[blocks.AT], []).extend(range(r._block << r._level, (r._block + 1) << r._level))
    assert all(sorted(v) == list(range(k)) for k, v in spans.items())


def test_refusals(spark, panel):
    class Peeks(Mean):
        target = ("position", "total_points")

    with pytest.raises(ValueError, match="total_points of a target"):
        backtest.walk_forward(panel, Peeks())

    class Short(Mean):
        def predict(self, state, target):
            return [1.0]

    with pytest.raises(Exception, match="predictions for"):
        backtest.walk_forward(panel, Short()).collect()
    with pytest.raises(ValueError, match="same aggregates"):
        predictors.AggregatePredictor([], {"a": F.lit(1)}, {"b": F.lit(1)}, F.lit(1))


def test_empty_frame(spark, panel):
    nothing = panel.limit(0)
    for predictor in (Mean(), aggregate_mean()):
        assert backtest.walk_forward(nothing, predictor, check=False).collect() == []
