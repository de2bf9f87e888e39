"""Dyadic blocks of a season's periods: a segment tree laid out as a table.

Periods of a season are numbered from 0. Block b of level j spans the 2**j periods from
b * 2**j. All periods before a cutoff c are the blocks named by the binary digits of c,
one for each digit that is 1, so what mergeable states must be moved for a cutoff grows with
the logarithm of the periods. Such blocks have even numbers, which halves the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import matched
from tidemark.session import counted
from tidemark.spec import PanelSpec

SEASON, AT = "_season_no", "_at"


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, F.lit(by) if isinstance(by, int) else by)


def numbered_periods(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """The period keys with a number for the season and, in it, for the period.

    One row per season and period, so a window over each is small; rows without a
    period belong to none.
    """
    periods = frame.select(*spec.period_keys).where(F.col(spec.period).isNotNull()).distinct()
    seasons = periods.select(spec.season).distinct().select(
        spec.season, (F.row_number().over(Window.orderBy(spec.season)) - 1).cast("long").alias(SEASON))
    at = (F.row_number().over(Window.partitionBy(SEASON).orderBy(spec.period)) - 1).cast("long")
    return counted(matched(periods, seasons, [spec.season], "inner").withColumn(AT, at), "periods")


def with_numbers(frame: DataFrame, periods: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows that have a period, with its numbers; periods are broadcast where few."""
    return matched(frame, periods, spec.period_keys, "inner")


def levels_of(periods: DataFrame) -> int:
    """Levels that a prefix of any season can need."""
    return int(periods.agg(F.max(AT)).first()[0] or 0).bit_length()


def in_blocks(states: DataFrame, levels: int) -> DataFrame:
    """Each row once for every level at which its period's block can be asked for."""
    if not levels:
        return states.withColumns({"_level": F.lit(0), "_block": F.col(AT)}).limit(0)
    each = states.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    each = each.withColumn("_block", _shift("shiftright", F.col(AT), F.col("_level")))
    return each.where(F.col("_block") % 2 == 0)


def blocks_before(cutoffs: DataFrame, levels: int) -> DataFrame:
    """The blocks whose union is all periods before ``AT``, one row each."""
    if not levels:
        return cutoffs.withColumns({"_level": F.lit(0), "_block": F.col(AT)}).limit(0)
    each = cutoffs.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    digit = _shift("shiftright", F.col(AT), F.col("_level"))
    return each.where(digit % 2 == 1).withColumn("_block", digit - 1)
