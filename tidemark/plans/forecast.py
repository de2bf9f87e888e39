"""From the newest full capture to logged predictions of the next period."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import baselines, clean, features, live
from tidemark.plans import feature_state, prediction_log
from tidemark.plans.feature_state import FeatureState
from tidemark.session import written
from tidemark.sources import captures
from tidemark.spec import PanelSpec

# Features run inside one entity's season of one capture run.
RUN_SPEC = PanelSpec(season="run_season")


def _largest(rows: DataFrame, *keys: str) -> int:
    return int(rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)


def parsed(bootstrap: DataFrame) -> DataFrame:
    """The documents as a written table: entities, stubs and periods read their columns of it."""
    return written(bootstrap, "bootstraps")


def live_rows(bootstrap: DataFrame, summaries: DataFrame) -> DataFrame:
    """Completed rows and stubs of every run as a written table: documents are parsed once,
    and bounds, features and targets read their columns of it."""
    rows = live.build(bootstrap, summaries).withColumn("run_season", F.concat_ws("|", "run", "season"))
    return written(rows, "live-rows")


def next_period_predictions(
    bootstrap: DataFrame, summaries: DataFrame, *, period_rows: int | None = None
) -> DataFrame:
    """Every rule's prediction for each run's next period, in long form.

    Completed rows and stubs share one feature pass, so the stub's lagged columns
    end at the deadline with no special case. Features run in one entity's season,
    ranks in one period, each with a bound counted on the rows.
    """
    bootstrap = parsed(bootstrap)
    rows = live_rows(bootstrap, summaries)
    featured = features.build(rows, RUN_SPEC, group_rows=_largest(rows, "run_season", "code"))
    target = live.next_period_rows(featured, captures.period_context(bootstrap))
    if period_rows is None:
        period_rows = _largest(rows, "run", "round")
    return baselines.predict_all(target, RUN_SPEC, group_rows=period_rows)


def split_at_deadline(rows: DataFrame, bootstrap: DataFrame, spec: PanelSpec = RUN_SPEC) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows before each run's next period, and those of it."""
    frame = clean.prepare(rows, spec)
    ahead = captures.period_context(bootstrap).select("run", F.col("next_event").cast("double").alias("_next"))
    placed = frame.join(ahead.where("_next is not null"), "run")
    history = placed.where(F.col(spec.period) < F.col("_next")).drop("_next")
    return history, placed.where(F.col(spec.period) == F.col("_next")).drop("_next")


def predictions_from_state(
    state: DataFrame, target: DataFrame, *, spec: PanelSpec = RUN_SPEC, period_rows: int | None = None
) -> DataFrame:
    """The same predictions, with the target's features taken from a state of its history."""
    featured = FeatureState(spec).attach(target, state)
    return baselines.predict_all(featured, spec, group_rows=period_rows)


def carried_state(spark: SparkSession, root: str, run: str, history: DataFrame, spec: PanelSpec) -> DataFrame:
    """The stored state brought to a run, and stored for the next one.

    A state of a later run than the one asked for is left alone and not used.
    """
    how, before = FeatureState(spec), feature_state.load(spark, root)
    if before is None:
        return feature_state.store(spark, root, run, how.fold(history))
    stored_run, state = before
    moment = lambda c: F.struct(scalars.run_moment(c), scalars.run_attempt(c), c)
    later = spark.createDataFrame([(stored_run, run)], "stored string, asked string").select(
        (moment(F.col("stored")) > moment(F.col("asked"))).alias("later")).first().later
    if later:
        return how.fold(history)
    advanced = how.advance(state, history)
    return feature_state.store(spark, root, run, advanced)


def forecast(
    spark: SparkSession,
    raw_root: str,
    log_root: str,
    *,
    capture: str | None = None,
    code_version: str | None = None,
    now: datetime | None = None,
    period_rows: int | None = None,
    state_root: str | None = None,
) -> dict[str, object]:
    """Predict and log. Returns the run's context, one small row.

    With ``state_root`` features come from a state that is kept there from run to run.
    """
    if capture is None:
        # From the names of files: the documents of other runs stay closed.
        newest = captures.newest_full_run(captures.summary_files(spark, raw_root)).first()
        if newest is None:
            raise FileNotFoundError(f"no run with per-entity documents under {raw_root}")
        capture = newest.run
    bootstrap = captures.read_bootstrap(spark, raw_root).where(F.col("run") == capture)
    summaries = captures.read_summaries(spark, raw_root).where(F.col("run") == capture)

    about = live.context(bootstrap, summaries).first().asDict()
    if not about["completed_rows"]:
        raise ValueError(f"run {capture} has no per-entity history")
    if about["next_gameweek"] is None:
        raise ValueError(f"run {capture} has no period still to come")
    prediction_log.guard_deadline(about["deadline"], now)
    if period_rows is None:
        period_rows = about["upcoming_rows"]

    # Written, as each rule reads it: lost executors lose none of it.
    if state_root is None:
        predictions = next_period_predictions(bootstrap, summaries, period_rows=period_rows)
    else:
        # One run's rows, so its seasons need no run in their key.
        spec, bootstrap = PanelSpec(), parsed(bootstrap)
        history, target = split_at_deadline(live_rows(bootstrap, summaries), bootstrap, spec)
        state = carried_state(spark, state_root, capture, history, spec)
        predictions = predictions_from_state(state, target, spec=spec, period_rows=period_rows)
    predicted = written(predictions, "forecast")
    prediction_log.write(
        spark,
        log_root,
        season=about["season"],
        gameweek=int(about["next_gameweek"]),
        deadline=about["deadline"],
        capture=capture,
        predictions={
            name: predicted.where(F.col("baseline") == name) for name in baselines.RULES
        },
        context=about,
        code_version=code_version,
        now=now,
        group_rows=period_rows,
    )
    return about
