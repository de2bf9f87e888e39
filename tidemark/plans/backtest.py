"""Walk-forward evaluation without a loop over periods.

For a period k a predictor may use rows of the same season before k. Rules over
lagged columns meet that by construction, so they are applied to all rows at
once. A predictor that learns from the history is best given as one of
``plans.predictors``, whose states merge: each cutoff then costs the logarithm of the
periods. A predictor that cannot be, gets the history set-based: one history table in
which every row appears once per later cutoff, keyed by ``cutoff``, so that its
own grouping handles all cutoffs in one job and pre-aggregates before shuffling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import baselines, metrics, shrinkage
from tidemark.plans import predictors
from tidemark.session import counted, written
from tidemark.spec import PanelSpec

# (history with cutoff, target with cutoff) -> target rows with ``prediction``.
Predictor = Callable[[DataFrame, DataFrame], DataFrame]

FIRST = fixed_values.FIRST_SCORED_PERIOD


def as_results(predicted: DataFrame, spec: PanelSpec, *extra: str) -> DataFrame:
    """Keyed results: who, when, what was said and what happened."""
    name = [spec.name] if spec.name in predicted.columns else []
    return predicted.select(
        *extra,
        *spec.period_keys,
        spec.entity,
        *name,
        spec.group,
        F.col("prediction").cast("double").alias("prediction"),
        F.col(spec.outcome).alias("actual"),
        spec.exposure,
    )


def require_targets(frame: DataFrame, spec: PanelSpec, first_period: int) -> None:
    """Raise where no row would be predicted; reads one row at most."""
    if frame.where(F.col(spec.period) >= first_period).select(spec.period).isEmpty():
        raise ValueError(f"no rows at or after period {first_period}; nothing to predict")


def history_by_cutoff(frame: DataFrame, spec: PanelSpec, first_period: int = FIRST) -> DataFrame:
    """Every row once per later cutoff of its season, as column ``cutoff``.

    The cutoffs of a season are one short array (as many as it has periods), so
    the copies arise inside a task and only what the predictor makes of them is
    shuffled.
    """
    cutoffs = (
        frame.select(*spec.period_keys)
        .where(F.col(spec.period) >= first_period)
        .distinct()
        .groupBy(spec.season)
        .agg(F.collect_set(spec.period).alias("_cutoffs"))
    )
    later = F.filter("_cutoffs", lambda c: c > F.col(spec.period))
    cutoffs = counted(cutoffs, "cutoffs", F.size("_cutoffs"))
    return frame.join(cutoffs, spec.season).withColumn("cutoff", F.explode(later)).drop("_cutoffs")


def walk_forward(
    frame: DataFrame,
    predictor: str | Predictor | predictors.MergeablePredictor | predictors.AggregatePredictor,
    spec: PanelSpec | None = None,
    *,
    first_period: int = FIRST,
    check: bool = True,
) -> DataFrame:
    """Results of one rule (by name), of a predictor with states, or of a function of DataFrames."""
    spec = spec or PanelSpec()
    if check:
        require_targets(frame, spec, first_period)
    target = frame.where(F.col(spec.period) >= first_period)
    if isinstance(predictor, str):
        return as_results(baselines.predict(target, predictor, spec), spec)
    if isinstance(predictor, predictors.AggregatePredictor):
        return as_results(predictors.predict_aggregates(frame, predictor, spec, first_period), spec)
    if isinstance(predictor, predictors.MergeablePredictor):
        roles = [*spec.period_keys, spec.entity, spec.name, spec.group, spec.outcome, spec.exposure]
        keep = [c for c in dict.fromkeys(roles) if c in frame.columns]
        return as_results(predictors.predict_mergeable(frame, predictor, spec, first_period, keep), spec)
    history = history_by_cutoff(frame, spec, first_period)
    predicted = predictor(history, target.withColumn("cutoff", F.col(spec.period)))
    missing = {spec.season, spec.period, spec.entity, "prediction"} - set(predicted.columns)
    if missing:
        raise ValueError(f"predictor result lacks {', '.join(sorted(missing))}")
    return as_results(predicted, spec)


def walk_forward_shrinkage(
    frame: DataFrame,
    spec: PanelSpec | None = None,
    *,
    past_seasons: DataFrame | None = None,
    limits: shrinkage.FitLimits | None = None,
    first_period: int = FIRST,
    group_rows: int | None = None,
    check: bool = True,
) -> DataFrame:
    """Shrinkage with a prior fixed from past seasons, or refitted at every cutoff."""
    spec = spec or PanelSpec()
    if check:
        require_targets(frame, spec, first_period)
    if past_seasons is None:
        predicted = shrinkage.predict_walking(
            frame, spec, limits, first_period=first_period, group_rows=group_rows
        )
    else:
        prior = shrinkage.fit(past_seasons, spec, limits, group_rows=group_rows)
        target = frame.where(F.col(spec.period) >= first_period)
        predicted = shrinkage.predict(prior, target, spec, group_rows=group_rows)
    return as_results(predicted, spec)


def _result_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    roles = [*spec.period_keys, spec.entity, spec.name, spec.group, spec.outcome, spec.exposure]
    return [c for c in df.columns if c in roles or c.startswith("_by_")]


def baseline_results(
    frame: DataFrame,
    spec: PanelSpec | None = None,
    *,
    rules: list[str] | None = None,
    first_period: int = FIRST,
    group_rows: int | None = None,
    keep: bool = False,
    check: bool = True,
) -> DataFrame:
    """Results of all rules in long form, keyed by ``baseline``.

    ``keep`` writes the predictions, one column per rule, to the shared folder
    first: worth it whenever more than one metric reads them.
    """
    spec = spec or PanelSpec()
    if check:
        require_targets(frame, spec, first_period)
    target = frame.where(F.col(spec.period) >= first_period)
    wide = baselines.attach_all(target, spec, rules, group_rows=group_rows)
    wide = wide.select(*_result_columns(wide, spec))
    scored = baselines.in_rows(written(wide, "predictions") if keep else wide)
    return as_results(scored, spec, "baseline", "on_scale")


def compare_baselines(
    frame: DataFrame,
    spec: PanelSpec | None = None,
    *,
    rules: list[str] | None = None,
    first_period: int = FIRST,
    k: int = fixed_values.TOP_K,
    group_rows: int | None = None,
    keep: bool = True,
) -> DataFrame:
    """Leaderboard, best rank agreement first, unscored rules last."""
    spec = spec or PanelSpec()
    results = baseline_results(
        frame, spec, rules=rules, first_period=first_period, group_rows=group_rows, keep=keep
    )
    scores = metrics.score(
        results,
        spec,
        ["baseline", "on_scale"],
        k=k,
        on_scale=F.col("on_scale"),
        group_rows=group_rows,
    )
    return scores.drop("on_scale").orderBy(F.col("rank_corr").desc_nulls_last(), "baseline")
