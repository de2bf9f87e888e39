"""Putting sources together: provenance, alignment by name, key bridge, labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.classes import ColumnClasses


def tag(df: DataFrame, provenance: str) -> DataFrame:
    """Mark where the rows came from."""
    return df.withColumn("provenance", F.lit(provenance))


def align(sources: Sequence[DataFrame], classes: ColumnClasses | None = None) -> DataFrame:
    """Union by column name; a column a source lacks is null for its rows.

    Every source must say where it comes from: once rows are mixed, nothing else
    tells which of them carry point-in-time guarantees.
    """
    if not sources:
        raise FileNotFoundError("no sources to combine")
    for df in sources:
        if "provenance" not in df.columns:
            raise ValueError("tag each source with its provenance before combining")
        if classes is not None:
            classes.check(df.columns)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def attach_code(panel: DataFrame, bridge: DataFrame) -> DataFrame:
    """Permanent code by (season, element); null where the bridge has none.

    The bridge has a row per entity and season; adaptive execution broadcasts it
    only where its measured size allows.
    """
    codes = bridge.select("season", "element", "code")
    return panel.drop("code").join(codes, ["season", "element"], "left")


def attach_label(
    df: DataFrame, labels: DataFrame, key: str, label_key: str, label: str, out: str
) -> DataFrame:
    """Look ``key`` up in a dimension; unmatched rows get null."""
    looked_up = labels.select(F.col(label_key).alias(key), F.col(label).alias(out))
    return df.join(looked_up, key, "left")
