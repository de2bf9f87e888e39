"""From raw string rows to rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.spec import PanelSpec


def tolerant_double(name: str) -> Column:
    """A double, or null where the text is not a number.

    Java also reads a trailing d or f as part of a number; here such text is not
    a number. Only text that holds one of these letters is matched for that.
    """
    text = F.col(name).cast("string")
    number = text.try_cast("double")
    lettered = F.translate(text, "dDfF", "") != text
    return F.when(lettered & text.rlike(r"[0-9.][dDfF]\s*$"), None).otherwise(number)


def tolerant_long(name: str) -> Column:
    """A long, or null. Text such as '6.0' is not an integer."""
    return F.col(name).cast("string").try_cast("bigint")


def drop_groups(
    df: DataFrame, column: str, dropped: list[str] = fixed_values.DROPPED_GROUPS
) -> DataFrame:
    """Rows without a group, or of a dropped one, go; without the column, all stay."""
    if column not in df.columns:
        return df
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(dropped))


def recode(
    df: DataFrame, column: str, codes: dict[str, str] = fixed_values.GROUP_RECODES
) -> DataFrame:
    return df.replace(codes, subset=[column]) if column in df.columns else df


def cast_numeric(df: DataFrame, names: list[str] = fixed_values.NUMERIC) -> DataFrame:
    """Tolerant cast of those listed columns that exist and are not numbers yet."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    casts = {c: tolerant_double(c) for c in names if c in text}
    casts |= {c: F.col(c).cast("double") for c in names if c in set(df.columns) - text}
    return df.withColumns(casts)


def require_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.where(F.col(spec.entity).isNotNull() & F.col(spec.period).isNotNull())


def prepare(panel: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """Drop, recode, cast, require keys. Narrow steps only; nothing is shuffled.

    There is no sort: the windows that need an order carry it themselves.
    """
    spec = spec or PanelSpec()
    kept = drop_groups(panel, spec.group)
    if dict(kept.dtypes).get(spec.group) == "string":
        kept = recode(kept, spec.group)
    if spec.entity not in kept.columns:
        kept = kept.withColumn(spec.entity, F.lit(None).cast("string"))
    return require_keys(cast_numeric(kept), spec)


def dropped_by_season(panel: DataFrame, spec: PanelSpec | None = None) -> DataFrame:
    """How many rows ``prepare`` removes, per season and reason.

    A season without the group column loses all its rows once another season has
    it; this report makes that visible.
    """
    spec = spec or PanelSpec()
    group = F.col(spec.group) if spec.group in panel.columns else F.lit("")
    return panel.groupBy(spec.season).agg(
        F.count("*").alias("rows"),
        F.count_if(group.isNull()).alias("no_group"),
        F.count_if(group.isin(fixed_values.DROPPED_GROUPS)).alias("dropped_group"),
        F.count_if(F.col(spec.entity).isNull()).alias("no_entity"),
    )
