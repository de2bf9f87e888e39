"""Derived season totals against an official record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.functions import scalars
from tidemark.functions.names import fold_name
from tidemark.operators.clean import tolerant_long
from tidemark.session import written
from tidemark.sources import captures


def derived_totals(
    panel: DataFrame, by: str = "code", *, merge_spellings: bool = True
) -> DataFrame:
    """Season totals the panel implies, by permanent code or by folded name.

    Names are folded after a first sum by raw name, so each spelling is folded
    once, and summed again, since two spellings may fold to one name. Without
    ``merge_spellings`` each spelling keeps a total of its own, and a join by folded
    name meets every one of them.
    """
    points = panel.where(F.col("total_points").isNotNull()).withColumn(
        "_points", tolerant_long("total_points")
    )
    if by == "code":
        rows = points.where(F.col("code").isNotNull())
        return rows.groupBy("season", "code").agg(
            F.coalesce(F.sum("_points"), F.lit(0)).alias("backfill_points")
        )
    spellings = points.groupBy("season", "name").agg(
        F.coalesce(F.sum("_points"), F.lit(0)).alias("_sum")
    )
    # Written, or the join's null test would fold every name a second time.
    folded = written(spellings.withColumn("name_n", fold_name(F.col("name"))), "folded-names")
    if not merge_spellings:
        return folded.select(
            "season", "name_n", F.col("_sum").alias("backfill_points"),
            F.lit(1).cast("long").alias("spellings"),
        )
    return folded.groupBy("season", "name_n").agg(
        F.sum("_sum").alias("backfill_points"), F.count("*").alias("spellings")
    )


def official_totals(bootstrap: DataFrame, summaries: DataFrame) -> DataFrame:
    """code, name_n, season, official_points from the past-season lists."""
    entities = captures.entity_dimension(bootstrap).select("run", "element", "code", "name")
    past = summaries.select(
        "run", F.col("element").cast("string").alias("element"), "history_past"
    )
    named = written(entities.withColumn("name_n", fold_name(F.col("name"))), "named-entities")
    rows = named.join(past, ["run", "element"]).select(
        "run", "code", "name_n", F.explode("history_past").alias("_p")
    )
    return rows.select(
        "run",
        "code",
        "name_n",
        scalars.dashed_season(F.col("_p.season_name")).alias("season"),
        F.col("_p.total_points").try_cast("bigint").alias("official_points"),
    )


def has_codes(panel: DataFrame) -> bool:
    """Whether any row carries a permanent code; stops at the first one found."""
    if "code" not in panel.columns:
        return False
    return not panel.where(F.col("code").isNotNull()).select("code").isEmpty()


def matched_totals(
    official: DataFrame, panel: DataFrame, by: str | None = None, *, merge_spellings: bool = True
) -> DataFrame:
    """Official beside derived totals, by code if the panel has codes, else by name.

    Official totals of several runs stay apart, by their ``run``.
    """
    by = by or ("code" if has_codes(panel) else "name")
    key = "code" if by == "code" else "name_n"
    derived = derived_totals(panel, by, merge_spellings=merge_spellings)
    return official.join(derived, [key, "season"])


def agreement(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """matched, agreed, agreement_rate (null where nothing matched) and note.

    One row, or one for each value of the columns ``by``, such as the run: each run
    holds every total again, so runs are not to be counted together.
    """
    differs = F.col("official_points") != F.col("backfill_points")
    counted = matched.groupBy(*(by or [])).agg(
        F.count("*").alias("matched"), (F.count("*") - F.count_if(differs)).alias("agreed")
    )
    return counted.select(
        *(by or []),
        "matched",
        "agreed",
        F.round(F.try_divide(F.col("agreed").cast("double"), F.col("matched")), 4).alias(
            "agreement_rate"
        ),
        F.when(F.col("matched") == 0, "nothing matched").alias("note"),
    )


def disagreements(
    matched: DataFrame, key: str = "code", limit: int = fixed_values.REPORTED_DISAGREEMENTS
) -> DataFrame:
    """The report's list of differing totals: the first ``limit`` by season and key."""
    return (
        matched.where(F.col("official_points") != F.col("backfill_points"))
        .select(
            F.col(key).alias("player"),
            "season",
            F.col("official_points").alias("official"),
            F.col("backfill_points").alias("backfill"),
        )
        .orderBy("season", "player")
        .limit(limit)
    )
