"""Panel rows for the season in progress, from capture documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.functions import scalars
from tidemark.operators import combine
from tidemark.session import written
from tidemark.sources import captures

PROVENANCE = "capture"


def completed_history(
    bootstrap: DataFrame, summaries: DataFrame, fields: list[str] = fixed_values.HISTORY_FIELDS
) -> DataFrame:
    """One row per history entry; values as text, null stays null.

    Entities without a readable document have no rows. The explode comes after
    the join, so documents are joined once each, not once per entry.
    """
    return _history(captures.entity_dimension(bootstrap), summaries, fields)


def _history(entities: DataFrame, summaries: DataFrame, fields: list[str]) -> DataFrame:
    held = summaries.select("run", F.col("element").cast("string").alias("element"), "history")
    rows = entities.join(held, ["run", "element"]).withColumn("_h", F.explode("history"))
    found = rows.select(
        "run", "season", "code", "name", "position", "team", "element",
        *[F.try_element_at(F.col("_h"), F.lit(f)).alias(f) for f in fields],
    )
    return combine.tag(found, PROVENANCE)


def upcoming_stubs(bootstrap: DataFrame) -> DataFrame:
    """One row per entity for the next period, with pre-deadline columns only.

    Runs without a next period give no rows. Outcomes are absent, so they become
    null beside completed rows and no feature can read them.
    """
    return _stubs(_listed(bootstrap))


def _stubs(listed: DataFrame) -> DataFrame:
    return combine.tag(listed.where("_ahead").drop("_ahead"), PROVENANCE)


def _listed(bootstrap: DataFrame) -> DataFrame:
    """One row per entity: its dimension, and its stub's columns where a period is still
    to come (``_ahead``); elsewhere they are null and not computed."""
    event = scalars.first_where(F.col("events"), lambda e: e["is_next"])
    listed = bootstrap.select(
        "run", "element_types", "teams", "total_players",
        captures.season_column().alias("season"),
        event.alias("_event"),
        F.explode("elements").alias("_e"),
    )
    e, ahead = F.col("_e"), F.col("_event").isNotNull()
    text = {
        "round": F.col("_event.id"),
        "value": e["now_cost"],
        "selected": scalars.owner_count(
            F.coalesce(scalars.blank_to_null(e["selected_by_percent"]).cast("double"), F.lit(0.0)),
            F.coalesce(F.col("total_players"), F.lit(0)),
        ),
        "transfers_in": F.coalesce(e["transfers_in_event"], F.lit(0)),
        "transfers_out": F.coalesce(e["transfers_out_event"], F.lit(0)),
        "transfers_balance": scalars.net(e["transfers_in_event"], e["transfers_out_event"]),
        "xP": F.coalesce(scalars.blank_to_null(e["ep_next"]), F.lit("0.0")),
        "status": e["status"],
        "chance_of_playing": e["chance_of_playing_next_round"],
        "news": scalars.blank_to_null(e["news"]),
    }
    return listed.select(
        "run", "season", *captures.entity_columns(e), ahead.alias("_ahead"),
        *[F.when(ahead, value.cast("string")).alias(name) for name, value in text.items()],
    )


def build(bootstrap: DataFrame, summaries: DataFrame) -> DataFrame:
    """Completed rows and upcoming stubs of every run, aligned by name.

    Listed entities are written, as both read them: the documents are parsed once.
    """
    listed = written(_listed(bootstrap), "listed-entities")
    dimension = listed.select("run", "season", "code", "name", "position", "team", "element")
    return combine.align(
        [_history(dimension, summaries, fixed_values.HISTORY_FIELDS), _stubs(listed)]
    )


def context(bootstrap: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per run: season, next period and deadline, and how many rows of each kind."""
    entries = (
        captures.entity_dimension(bootstrap)
        .select("run", "element")
        .join(
            summaries.select(
                "run", F.col("element").cast("string").alias("element"),
                F.coalesce(F.array_size("history"), F.lit(0)).alias("_entries"),
            ),
            ["run", "element"],
        )
        .groupBy("run")
        .agg(F.sum("_entries").alias("completed_rows"))
    )
    ahead = captures.period_context(bootstrap).withColumnsRenamed(
        {"next_event": "next_gameweek", "next_deadline": "deadline"}
    )
    listed = bootstrap.select("run", F.array_size("elements").alias("_listed"))
    return (
        captures.season_label(bootstrap)
        .join(ahead, "run")
        .join(listed, "run")
        .join(entries, "run", "left")
        .select(
            "run",
            "season",
            "next_gameweek",
            "deadline",
            F.coalesce("completed_rows", F.lit(0)).alias("completed_rows"),
            F.when(F.col("next_gameweek").isNotNull(), F.coalesce("_listed", F.lit(0)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("upcoming_rows"),
        )
    )


def next_period_rows(featured: DataFrame, ahead: DataFrame) -> DataFrame:
    """Rows of each run's next period only."""
    wanted = ahead.select("run", F.col("next_event").cast("double").alias("round"))
    return featured.join(wanted, ["run", "round"], "left_semi")
