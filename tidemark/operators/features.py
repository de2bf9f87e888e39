"""Lagged and season-to-date features that cannot see their own period.

An outcome reaches a feature only through ``lagged`` or ``expanding``; both
describe frames that end one row before the current one, and there is no
parameter to change that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.classes import FOOTBALL, ColumnClasses
from tidemark.operators import clean, ordered
from tidemark.spec import PanelSpec


@dataclass(frozen=True)
class Lag:
    """A mean or sum over the ``rows`` rows before the current one."""

    name: str
    value: str
    rows: int
    statistic: str


@dataclass(frozen=True)
class ToDate:
    """A sum or a count of values over all earlier rows of the season."""

    name: str
    value: str
    statistic: str


Feature = Lag | ToDate


def lagged(
    column: str, rows: int, statistic: str = "mean", classes: ColumnClasses = FOOTBALL
) -> Lag:
    """Only outcomes are lagged; anything already knowable is used directly."""
    if classes.classify(column) != "outcome":
        raise ValueError(f"{column} is knowable before the deadline; use it as it is")
    if statistic not in ("mean", "sum"):
        raise KeyError(statistic)
    return Lag(f"{column}_{statistic}{rows}", column, rows, statistic)


def expanding(column: str, statistic: str = "sum", classes: ColumnClasses = FOOTBALL) -> ToDate:
    """A total to date. Any classified column may be totalled."""
    classes.classify(column)
    if statistic not in ("sum", "count"):
        raise KeyError(statistic)
    return ToDate(f"{column}_todate_{statistic}", column, statistic)


def standard_features(
    spec: PanelSpec | None = None, classes: ColumnClasses = FOOTBALL
) -> list[Feature]:
    spec = spec or PanelSpec()
    started = f"cast({spec.exposure} >= {fixed_values.STARTED_EXPOSURE} as double)"
    appeared = f"cast({spec.exposure} > 0 as double)"
    return [
        lagged(spec.outcome, 5, classes=classes),
        lagged(spec.outcome, 10, classes=classes),
        lagged(spec.exposure, 3, classes=classes),
        lagged(spec.exposure, 5, classes=classes),
        expanding(spec.outcome, classes=classes),
        expanding(spec.exposure, classes=classes),
        Lag("started_rate5", started, 5, "mean"),
        ToDate("appearances_todate", appeared, "sum"),
    ]


def per_full_exposure(spec: PanelSpec) -> Column:
    """Outcome per 90 of exposure to date; null until there is exposure."""
    exposed = F.col(f"{spec.exposure}_todate_sum")
    earned = F.col(f"{spec.outcome}_todate_sum")
    return F.when(exposed > 0, earned / exposed * F.lit(fixed_values.FULL_EXPOSURE))


def _rolling(feature: Lag, w: Window) -> Column:
    frame = w.rowsBetween(-feature.rows, -1)
    fold = F.avg if feature.statistic == "mean" else F.sum
    return fold(F.expr(feature.value)).over(frame).alias(feature.name)


def _known_before(feature: ToDate, w: Window) -> Column:
    """A to-date sum is undefined right after a row that had no value."""
    return F.lag(F.expr(feature.value)).over(w).isNotNull()


def _by_window(
    df: DataFrame, keys: list[str], order: list[str], features: Sequence[Feature]
) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for feature in features:
        if isinstance(feature, Lag):
            columns.append(_rolling(feature, w))
        elif feature.statistic == "count":
            columns.append(F.count(F.expr(feature.value)).over(earlier).alias(feature.name))
        else:
            total = F.sum(F.expr(feature.value)).over(earlier)
            columns.append(F.when(_known_before(feature, w), total).alias(feature.name))
    return df.select("*", *columns)


def _by_chunks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    features: Sequence[Feature],
    group_rows: int,
) -> DataFrame:
    """The same features for an entity whose season does not fit one task.

    Totals to date come from distributed running totals. For the short frames
    every row learns its place in the season, seasons are cut into chunks of
    equal length, and the last few rows of a chunk also visit the next one so
    that no frame is cut. ``order`` must be unique within an entity's season.
    """
    totals = {"_place": F.lit(1)}
    for feature in features:
        if isinstance(feature, ToDate):
            value = F.expr(feature.value)
            known = value.isNotNull().cast("long")
            totals[f"_run_{feature.name}"] = known if feature.statistic == "count" else value
    run = ordered.with_totals_before(df, keys, [F.col(c) for c in order], totals, group_rows)
    run = run.withColumn("_place", F.coalesce("_place", F.lit(0)))

    reach = max([f.rows for f in features if isinstance(f, Lag)], default=1)
    length = max(4 * reach, group_rows // ordered.BUCKETS_PER_GROUP)
    chunk = F.floor(F.col("_place") / F.lit(length))
    near_end = F.col("_place") % F.lit(length) >= F.lit(length - reach)
    visits = F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    cut = run.withColumn("_home", chunk).withColumn("_chunk", F.explode(visits))

    w = Window.partitionBy(*keys, "_chunk").orderBy("_place")
    columns = []
    for feature in features:
        if isinstance(feature, Lag):
            columns.append(_rolling(feature, w))
        elif feature.statistic == "count":
            columns.append(F.coalesce(f"_run_{feature.name}", F.lit(0)).alias(feature.name))
        else:
            total = F.col(f"_run_{feature.name}")
            columns.append(F.when(_known_before(feature, w), total).alias(feature.name))
    placed = cut.select("*", *columns).where(F.col("_chunk") == F.col("_home"))
    return placed.select(*df.columns, *[f.name for f in features])


def add_features(
    df: DataFrame,
    features: Sequence[Feature],
    spec: PanelSpec | None = None,
    *,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Add lagged and to-date columns; one exchange on (season, entity).

    ``group_rows`` bounds the rows of one entity's season, for instance by the
    number of periods; left out, it is measured. ``plan`` picks a plan.
    """
    spec = spec or PanelSpec()
    keys, order = spec.entity_keys, spec.time_order(df)
    rows = ordered.split_rows(df, keys, group_rows, plan)
    if rows is not None:
        return _by_chunks(df, keys, order, features, rows)
    return _by_window(df, keys, order, features)


def one_row_per_period(df: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Outcome and exposure summed to one row per entity and period."""
    spec = spec or PanelSpec()
    return df.groupBy(*spec.entity_keys, spec.period).agg(
        F.sum(spec.outcome).alias(spec.outcome), F.sum(spec.exposure).alias(spec.exposure)
    )


def build(
    panel: DataFrame,
    spec: PanelSpec | None = None,
    *,
    classes: ColumnClasses = FOOTBALL,
    strict: bool = False,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Clean the panel and add the standard feature set.

    With ``strict`` the frames step over whole periods instead of rows, so the
    second fixture of a double period cannot see the first.
    """
    spec = spec or PanelSpec()
    frame = clean.prepare(panel, spec)
    features = standard_features(spec, classes)
    if strict:
        keys = [*spec.entity_keys, spec.period]
        rolled = add_features(
            one_row_per_period(frame, spec), features, spec, group_rows=group_rows, plan=plan
        )
        frame = frame.join(rolled.select(*keys, *[f.name for f in features]), keys, "left")
    else:
        frame = add_features(frame, features, spec, group_rows=group_rows, plan=plan)
    return frame.withColumn("points_per90_todate", per_full_exposure(spec))
