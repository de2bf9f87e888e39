"""What a panel holds: coverage, season profile, column classes, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.classes import FOOTBALL, ColumnClasses


def counts_by_season(panel: DataFrame, season: str = "season") -> DataFrame:
    """season, column, n: non-null values, from one scan for all columns."""
    columns = [c for c in panel.columns if c != season]
    wide = panel.groupBy(season).agg(*[F.count(c).alias(c) for c in columns])
    return wide.unpivot(season, columns, "column", "n")


def coverage(panel: DataFrame, season: str = "season") -> DataFrame:
    """column, seasons: the seasons with data, in order; empty where there is none."""
    held = F.when(F.col("n") > 0, F.col(season))
    return (
        counts_by_season(panel, season)
        .groupBy("column")
        .agg(F.sort_array(F.collect_set(held)).alias("seasons"))
    )


def season_profile(
    panel: DataFrame,
    seasons: DataFrame,
    *,
    season: str = "season",
    period: str = "round",
) -> DataFrame:
    """Rows and periods per expected season; absent ones show as not vendored.

    ``seasons`` is the expected list with any columns to carry along (notes,
    encoding, column count). Periods are counted from (season, period) totals,
    so a season of any size sums up in its map tasks first.
    """
    per_period = panel.groupBy(season, period).agg(F.count("*").alias("_rows"))
    held = per_period.groupBy(season).agg(
        F.sum("_rows").alias("rows"),
        (F.count(period) + F.max(F.col(period).isNull().cast("int"))).alias("periods"),
    )
    return seasons.join(held, season, "left").select(
        *seasons.columns,
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("periods", F.lit(0)).alias("periods"),
        F.when(F.col("rows").isNull(), "not vendored").otherwise("ok").alias("status"),
    )


def class_report(
    spark: SparkSession, columns: Sequence[str], classes: ColumnClasses = FOOTBALL
) -> DataFrame:
    """column, class for each classified column, from names alone."""
    rows = [(c, label) for label, names in classes.report(columns).items() for c in names]
    return spark.createDataFrame(rows, "column string, class string")


def summary(
    panel: DataFrame,
    seasons: DataFrame,
    *,
    provenance: str = "backfill",
    point_in_time: bool = False,
    upstream: str | None = None,
    classes: ColumnClasses = FOOTBALL,
    season: str = "season",
    period: str = "round",
) -> DataFrame:
    """One nested row describing the panel; a few lists of column and season size."""
    report = classes.report(panel.columns)
    profile = season_profile(panel, seasons, season=season, period=period)
    carried = F.struct(*profile.columns)
    per_season = profile.agg(
        F.sum("rows").alias("rows"), F.array_sort(F.collect_list(carried)).alias("seasons")
    )
    covered = coverage(panel, season).agg(
        F.array_sort(F.collect_list(F.struct("column", "seasons"))).alias("coverage")
    )
    return per_season.select(
        "rows",
        F.lit(len(panel.columns)).alias("columns"),
        F.lit(provenance).alias("provenance"),
        F.lit(point_in_time).alias("point_in_time"),
        F.lit(upstream).cast("string").alias("upstream"),
        F.struct(
            *[F.array(*map(F.lit, names)).alias(label) for label, names in report.items()]
        ).alias("column_classes"),
        "seasons",
        covered.scalar().alias("coverage"),
    )
