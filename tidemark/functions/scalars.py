"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dashed_season(label: Column) -> Column:
    """2021/22 as 2021-22."""
    return F.replace(label, F.lit("/"), F.lit("-"))


def season_of_year(first_year: Column) -> Column:
    """2026 as 2026-27, and 1999 as 1999-00."""
    following = F.lpad(((first_year + 1) % 100).cast("string"), 2, "0")
    return F.concat_ws("-", first_year.cast("string"), following)


def period_label(period: Column) -> Column:
    """3 as gw03; three digits stay whole."""
    return F.format_string("gw%02d", period.cast("int"))


def full_name(first: Column, second: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))))


def owner_count(percent: Column, total: Column) -> Column:
    """A share in percent as a number of owners, cut to whole owners."""
    return (percent / F.lit(100.0) * total).cast("bigint")


def net(inward: Column, outward: Column) -> Column:
    """In minus out, with nothing counted as zero."""
    return F.coalesce(inward, F.lit(0)) - F.coalesce(outward, F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def run_moment(run: Column) -> Column:
    """The UTC instant in a run folder's name (the session runs in UTC)."""
    stamp = F.regexp_extract(run, r"^(.*Z)", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'"))


def run_attempt(run: Column) -> Column:
    """The number after the stamp where two runs began in one second, else 0."""
    digits = F.regexp_extract(run, r"Z[.]([0-9]+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def run_name(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def first_where(items: Column, test) -> Column:
    """The first element of an array that passes, or null."""
    return F.try_element_at(F.filter(items, test), F.lit(1))
