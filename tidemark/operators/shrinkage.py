"""Shrink a small-sample average toward a fitted prior.

    prediction = (total to date + k * prior mean) / (periods elapsed + k)

The prior is the mean outcome of the row's group and price bucket. ``k`` is the
within-entity variance over the between-entity variance (empirical Bayes).

``fit`` estimates one prior from past seasons. ``fit_each_cutoff`` estimates one
per (season, cutoff) from that season's earlier rows, for all cutoffs in one job:
each level is first summed per period, then accumulated over the periods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import ranks
from tidemark.session import counted, written
from tidemark.spec import PanelSpec


@dataclass(frozen=True)
class FitLimits:
    """Below these counts a fit falls back to full shrinkage."""

    buckets: int = fixed_values.PRICE_BUCKETS
    min_rows: int = fixed_values.MIN_FIT_ROWS
    min_entity_periods: int = fixed_values.MIN_ENTITY_PERIODS
    min_entities: int = fixed_values.MIN_FIT_ENTITIES
    fallback: float = fixed_values.FALLBACK_STRENGTH


@dataclass(frozen=True)
class Prior:
    """``table``: group, price_bucket, prior_mean. ``scalars``: k, grand_mean, one row."""

    table: DataFrame
    scalars: DataFrame
    limits: FitLimits

    def describe(self) -> str:
        row = self.scalars.first()
        return f"strength {row.k:.2f} (more shrinks more), overall mean {row.grand_mean:.2f}"


def strength(within: Column, spread: Column, mean_n: Column, entities: Column, limits: FitLimits):
    """k from the averaged moments, or the fallback where they say too little."""
    between = spread - within / mean_n
    usable = (entities > limits.min_entities) & (between > fixed_values.MIN_BETWEEN) & (within > 0)
    return F.when(usable, F.try_divide(within, between)).otherwise(F.lit(limits.fallback))


def usable_rows(
    history: DataFrame, spec: PanelSpec, limits: FitLimits, group_rows: int | None = None
) -> DataFrame:
    """Rows with outcome, price and group, bucketed among themselves."""
    named = history.select(
        spec.season, spec.period, spec.entity, spec.group, spec.price,
        F.col(spec.outcome).cast("double").alias("_y"),
    )
    complete = named.dropna(subset=["_y", spec.price, spec.group])
    return ranks.price_bucket(complete, spec, buckets=limits.buckets, group_rows=group_rows)


def prior_table(usable: DataFrame, spec: PanelSpec, limits: FitLimits) -> DataFrame:
    """Mean outcome per group and bucket; empty where history is too short."""
    cells = usable.groupBy(spec.group, "price_bucket").agg(
        F.sum("_y").alias("_sum"), F.count("*").alias("_n")
    )
    # A few dozen cells: the grand total over them needs no second scan.
    total = cells.agg(F.sum("_n").alias("n")).scalar()
    return cells.where(total >= limits.min_rows).select(
        spec.group, "price_bucket", (F.col("_sum") / F.col("_n")).alias("prior_mean")
    )


def entity_moments(usable: DataFrame, spec: PanelSpec, limits: FitLimits) -> DataFrame:
    """Mean, sample variance and row count per entity and season, if enough rows."""
    return (
        usable.groupBy(*spec.entity_keys)
        .agg(
            F.avg("_y").alias("entity_mean"),
            F.var_samp("_y").alias("entity_var"),
            F.count("*").alias("n"),
        )
        .where((F.col("n") >= limits.min_entity_periods) & F.col("entity_var").isNotNull())
    )


def fit(
    history: DataFrame,
    spec: PanelSpec | None = None,
    limits: FitLimits | None = None,
    *,
    group_rows: int | None = None,
) -> Prior:
    """One prior from all of ``history``, fitted now and kept as two small tables."""
    spec, limits = spec or PanelSpec(), limits or FitLimits()
    lean = usable_rows(history, spec, limits, group_rows)
    usable = written(lean.select(*spec.entity_keys, spec.group, "price_bucket", "_y"), "usable")
    overall = usable.agg(F.avg("_y").alias("mean"), F.count("*").alias("n"))
    moments = entity_moments(usable, spec, limits).agg(
        F.avg("entity_var").alias("within"),
        F.var_samp("entity_mean").alias("spread"),
        F.avg("n").alias("mean_n"),
        F.count("*").alias("entities"),
    )
    fitted = strength(
        F.col("within"), F.col("spread"), F.col("mean_n"), F.col("entities"), limits
    )
    k = moments.select(fitted.alias("k")).scalar()
    scalars = overall.select(
        F.when(F.col("n") < limits.min_rows, F.lit(limits.fallback)).otherwise(k).alias("k"),
        F.coalesce(F.col("mean"), F.lit(0.0)).alias("grand_mean"),
    )
    table = counted(prior_table(usable, spec, limits), "prior")
    return Prior(table, written(scalars, "prior-scalars"), limits)


def shrunk(spec: PanelSpec, prior_mean: Column, k: Column) -> Column:
    """Periods elapsed, not rows: a period missed is evidence as well."""
    elapsed = F.greatest(F.col(spec.period).cast("double") - 1, F.lit(0.0))
    earned = F.coalesce(F.col(f"{spec.outcome}_todate_sum"), F.lit(0.0))
    return (earned + k * prior_mean) / (elapsed + k)


def predict(
    prior: Prior,
    target: DataFrame,
    spec: PanelSpec | None = None,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """The target's rows with ``prediction``; rows keep their own keys."""
    spec = spec or PanelSpec()
    bucketed = ranks.price_bucket(
        target, spec, buckets=prior.limits.buckets, group_rows=group_rows
    )
    joined = bucketed.join(prior.table, [spec.group, "price_bucket"], "left")
    k = prior.scalars.select("k").scalar()
    mean = F.coalesce(F.col("prior_mean"), prior.scalars.select("grand_mean").scalar())
    return joined.select(*target.columns, shrunk(spec, mean, k).alias("prediction"))


def _accumulate(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Replace each column by its total over strictly earlier periods."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in columns})


def numbered_periods(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct periods of each season, numbered in order, with the season's last number."""
    season = Window.partitionBy(spec.season)
    return (
        frame.select(*spec.period_keys)
        .distinct()
        .where(F.col(spec.period).isNotNull())
        .select(
            *spec.period_keys,
            F.row_number().over(season.orderBy(spec.period)).alias("period_no"),
            F.count("*").over(season).cast("int").alias("last_no"),
        )
    )


def _strength_each_cutoff(
    usable: DataFrame, periods: DataFrame, spec: PanelSpec, limits: FitLimits
) -> DataFrame:
    """(season, period_no, k-moments) from each entity's running mean and variance.

    An entity's state changes only in periods it has rows in, so each state is
    spread over the cutoffs it holds for by an explode. The spread rows go
    straight into a partial aggregation keyed by cutoff and are never shuffled.
    Values are centred on their overall mean, which changes no variance and keeps
    the running sum of squares well conditioned.
    """
    centre = usable.agg(F.avg("_y")).scalar()
    # Sums per entity and period first: an entity with very many rows in one
    # season arrives at the window as one row per period.
    per_period = (
        usable.withColumn("_d", F.col("_y") - centre)
        .groupBy(*spec.entity_keys, spec.period)
        .agg(
            F.count("*").alias("_n"),
            F.sum("_d").alias("_s1"),
            F.sum(F.col("_d") * F.col("_d")).alias("_s2"),
        )
        .join(periods, spec.period_keys)
    )
    w = Window.partitionBy(*spec.entity_keys).orderBy("period_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = per_period.select(
        spec.season,
        "period_no",
        F.coalesce(F.lead("period_no").over(w), F.col("last_no")).alias("_until"),
        F.sum("_n").over(upto).alias("_n"),
        F.sum("_s1").over(upto).alias("_s1"),
        F.sum("_s2").over(upto).alias("_s2"),
    ).where(
        (F.col("_n") >= limits.min_entity_periods)
        & (F.col("_n") > 1)
        & (F.col("_until") > F.col("period_no"))
    )
    variance = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1)
    held = states.select(
        spec.season,
        F.explode(F.sequence(F.col("period_no") + 1, F.col("_until"))).alias("period_no"),
        (F.col("_s1") / F.col("_n")).alias("_mean"),
        F.greatest(variance, F.lit(0.0)).alias("_var"),
        "_n",
    )
    return held.groupBy(spec.season, "period_no").agg(
        F.avg("_var").alias("_within"),
        F.var_samp("_mean").alias("_spread"),
        F.avg("_n").alias("_mean_n"),
        F.count("*").alias("_entities"),
    )


def fit_each_cutoff(
    frame: DataFrame,
    spec: PanelSpec | None = None,
    limits: FitLimits | None = None,
    *,
    first_period: int = fixed_values.FIRST_SCORED_PERIOD,
    group_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(prior table, scalars), both keyed by season and the period predicted.

    The usable rows are written once for the three levels that sum them; the two
    results are small tables, written as well.
    """
    spec, limits = spec or PanelSpec(), limits or FitLimits()
    season, period = spec.season, spec.period
    lean = usable_rows(frame, spec, limits, group_rows)
    usable = written(
        lean.select(season, period, spec.entity, spec.group, "price_bucket", "_y"), "usable"
    )
    periods = counted(numbered_periods(frame, spec), "periods")

    cells = usable.groupBy(season, period, spec.group, "price_bucket").agg(
        F.sum("_y").alias("_sum"), F.count("*").cast("double").alias("_n")
    )
    slots = cells.select(season, spec.group, "price_bucket").distinct()
    grid = slots.join(periods.select(season, period), season).join(
        cells, [season, period, spec.group, "price_bucket"], "left"
    )
    before = _accumulate(grid, [season, spec.group, "price_bucket"], period, ["_sum", "_n"])
    table = before.where((F.col("_n") > 0) & (F.col(period) >= first_period)).select(
        season, period, spec.group, "price_bucket",
        (F.col("_sum") / F.col("_n")).alias("prior_mean"),
    )

    overall = periods.join(
        cells.groupBy(season, period).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")),
        [season, period],
        "left",
    )
    overall = _accumulate(overall, [season], period, ["_sum", "_n"])
    moments = _strength_each_cutoff(usable, periods, spec, limits)
    k = strength(
        F.col("_within"), F.col("_spread"), F.col("_mean_n"), F.col("_entities"), limits
    )
    fitted = F.col("_n") >= limits.min_rows
    scalars = (
        overall.join(moments, [season, "period_no"], "left")
        .where(F.col(period) >= first_period)
        .select(
            season,
            period,
            fitted.alias("fitted"),
            F.when(fitted, k).otherwise(F.lit(limits.fallback)).alias("k"),
            F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)).alias("grand_mean"),
        )
    )
    return counted(table, "priors"), counted(scalars, "prior-scalars")


def predict_walking(
    frame: DataFrame,
    spec: PanelSpec | None = None,
    limits: FitLimits | None = None,
    *,
    first_period: int = fixed_values.FIRST_SCORED_PERIOD,
    group_rows: int | None = None,
) -> DataFrame:
    """Every row from ``first_period`` on, predicted from a prior refitted before it."""
    spec, limits = spec or PanelSpec(), limits or FitLimits()
    table, scalars = fit_each_cutoff(
        frame, spec, limits, first_period=first_period, group_rows=group_rows
    )
    target = frame.where(F.col(spec.period) >= first_period)
    bucketed = ranks.price_bucket(target, spec, buckets=limits.buckets, group_rows=group_rows)
    joined = bucketed.join(scalars, spec.period_keys, "left").join(
        table, [*spec.period_keys, spec.group, "price_bucket"], "left"
    )
    # Below the row limit the table counts as empty and the overall mean is used.
    known = F.when(F.col("fitted"), F.col("prior_mean"))
    mean = F.coalesce(known, F.col("grand_mean"))
    return joined.select(*frame.columns, shrunk(spec, mean, F.col("k")).alias("prediction"))
