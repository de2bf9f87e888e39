"""Ranks, price buckets and output order.

Every function picks between two plans of equal result: a plain window, or, for
groups beyond ``ordered.WINDOW_GROUP_ROWS`` rows, a histogram of the distinct
values with distributed running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import ordered
from tidemark.session import counted, written
from tidemark.spec import PanelSpec


def average_rank_column(value: Column, keys: list[str | Column]) -> Column:
    """Average rank as one window expression; null stays null.

    ``rank`` is the first place a run of equal values takes, and half the run's
    length minus one moves it to the run's middle. Both windows share one
    partitioning and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    middle = F.rank().over(w) + (peers - 1) / F.lit(2.0)
    return F.when(value.isNotNull(), middle)


def _rank_by_histogram(
    df: DataFrame, keys: list[str], value: str, out: str, group_rows: int
) -> DataFrame:
    """Equal values collapse to one counted row before anything is ordered.

    A value that a third of the rows share is therefore one row here, and its rank
    goes back to those rows by broadcast.
    """
    df = written(df, "ranked")
    shape = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = ordered.with_totals_before(
        shape, keys, [F.col(value)], {"_before": F.col("_n")}, group_rows
    )
    first = F.coalesce(F.col("_before"), F.lit(0))
    ranks = placed.withColumn(out, first + (F.col("_n") + 1) / F.lit(2.0))
    return ordered.join_per_value(df, ranks, keys, value, "_n", out)


def average_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    *,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Average rank of ``value`` inside each group, ties sharing their middle.

    ``group_rows`` is a proven bound on the rows of a group; left out, it is
    measured with one aggregation. ``plan`` picks a plan whatever the bound.
    """
    rows = ordered.split_rows(df, keys, group_rows, plan)
    if rows is not None:
        return _rank_by_histogram(df, keys, value, out, rows)
    return df.withColumn(out, average_rank_column(F.col(value), keys))


def group_length(
    df: DataFrame,
    keys: list[str],
    out: str,
    *,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Rows in the group, nulls included, on every row."""
    if ordered.split_rows(df, keys, group_rows, plan) is not None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias(out))
        return ordered.matched(df, counted(sizes, "group-sizes"), keys, "left")
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def bucket_of_rank(rank: Column, length: Column, buckets: int) -> Column:
    """Rank to 1..buckets. Guarded, since least and greatest skip nulls."""
    raw = F.ceil(rank / length * F.lit(buckets))
    held = F.least(F.greatest(raw, F.lit(1)), F.lit(buckets)).cast("double")
    return F.when(rank.isNotNull(), held)


def price_bucket(
    df: DataFrame,
    spec: PanelSpec | None = None,
    *,
    buckets: int = fixed_values.PRICE_BUCKETS,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Add ``price_bucket``: the price's rank within its period, cut in tenths.

    Rank rather than price, so that buckets compare across seasons of inflation.
    """
    spec = spec or PanelSpec()
    keys = spec.period_keys
    rows = ordered.resolve_group_rows(df, keys, group_rows)
    sized = group_length(df, keys, "_period_rows", group_rows=rows, plan=plan)
    ranked = average_rank(sized, keys, spec.price, "_price_rank", group_rows=rows, plan=plan)
    bucket = bucket_of_rank(F.col("_price_rank"), F.col("_period_rows"), buckets)
    return ranked.withColumn("price_bucket", bucket).drop("_price_rank", "_period_rows")


def output_rank(
    df: DataFrame,
    keys: list[str],
    prediction: str = "prediction",
    tiebreak: str = "code",
    *,
    out: str = "rank",
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """1..n by prediction, highest first, unscored rows last, ties by entity.

    NaN counts as higher than any number, as it does in a descending sort.
    """
    rows = ordered.split_rows(df, keys, group_rows, plan)
    if rows is not None:
        order = [
            F.col(prediction).isNull().alias("unscored"),
            (~F.isnan(prediction)).alias("number"),
            (-F.col(prediction)).alias("height"),
            F.col(tiebreak).alias("tie"),
        ]
        placed = ordered.with_totals_before(df, keys, order, {"_before": F.lit(1)}, rows)
        place = (F.coalesce(F.col("_before"), F.lit(0)) + 1).cast("int")
        return placed.withColumn(out, place).drop("_before")
    w = Window.partitionBy(*keys).orderBy(F.col(prediction).desc_nulls_last(), F.col(tiebreak))
    return df.withColumn(out, F.row_number().over(w))


def top_k(
    df: DataFrame, keys: list[str], value: str, tiebreak: str, k: int = fixed_values.TOP_K
) -> DataFrame:
    """The k highest rows of each group.

    The filter on row_number lets Spark keep k rows per group in each map task,
    so even one huge group sends only k rows per task through the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(tiebreak))
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")
