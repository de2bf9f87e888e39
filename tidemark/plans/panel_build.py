"""Season folders to one panel table with its summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.classes import FOOTBALL, ColumnClasses
from tidemark.operators import combine, profile
from tidemark.session import settings
from tidemark.sources import seasons as source

PROVENANCE = "backfill"


@dataclass(frozen=True)
class Panel:
    rows: DataFrame
    seasons: DataFrame
    summary: DataFrame


def _present(spark: SparkSession, root: str, seasons: Sequence[str], file: str) -> list[str]:
    """Which of the asked seasons have the file: names only, at most one per season."""
    try:
        found = source.listed_files(spark, root, [file]).where(F.col("season").isin(list(seasons)))
        have = {r.season for r in found.select("season").collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        have = set()  # the root itself is absent
    return [s for s in seasons if s in have]


def _formats(
    spark: SparkSession, root: str, seasons: list[str], file: str
) -> tuple[dict[str, str], set[str]]:
    """Encodings by season, and the seasons with line breaks inside quotes."""
    rows = source.detect_formats(spark, root, seasons, file).collect() if seasons else []
    return {r.season: r.encoding for r in rows}, {r.season for r in rows if r.multi_line}


def build(
    spark: SparkSession,
    root: str,
    seasons: Sequence[str],
    *,
    encodings: dict[str, str] | None = None,
    notes: dict[str, str] | None = None,
    upstream: str | None = None,
    classes: ColumnClasses = FOOTBALL,
) -> Panel:
    """Read every season found, align by name, attach permanent codes.

    The loop is over seasons (a dozen), each adding a lazy scan to one plan.
    Encodings are detected from the bytes unless given.
    """
    period_file, bridge_file = fixed_values.PERIOD_FILE, fixed_values.BRIDGE_FILE
    found = _present(spark, root, seasons, period_file)
    if not found:
        raise FileNotFoundError(f"no season folders with {period_file} under {root}")
    detected, broken = _formats(spark, root, found, period_file)
    known = encodings or detected
    frames = [
        source.read_season(
            spark, root, s, known.get(s, source.UTF8), classes=classes, multi_line=s in broken
        )
        for s in found
    ]
    widths = {s: len(f.columns) - 1 for s, f in zip(found, frames)}
    aligned = combine.align([combine.tag(f, PROVENANCE) for f in frames], classes)

    bridged = _present(spark, root, seasons, bridge_file)
    spelling, broken = _formats(spark, root, bridged, bridge_file)
    bridge = source.read_bridge(spark, root, bridged, spelling, multi_line=broken)
    if "element" in aligned.columns:
        aligned = combine.attach_code(aligned, bridge)
    elif "code" not in aligned.columns:
        aligned = aligned.withColumn("code", F.lit(None).cast("string"))

    expected = spark.createDataFrame(
        [(s, known.get(s), widths.get(s, 0)) for s in seasons],
        "season string, encoding string, columns int",
    ).join(source.season_notes(spark, notes), "season", "left")
    about = profile.summary(
        aligned, expected, provenance=PROVENANCE, upstream=upstream, classes=classes
    )
    return Panel(aligned, profile.season_profile(aligned, expected), about)


# Bytes of rows, before compression, that one file is meant to hold.
FILE_BYTES = 512 << 20


def write(
    panel: DataFrame, summary: DataFrame, dest: str, *, season: str = "season", file_bytes: int = FILE_BYTES
) -> str:
    """Parquet with zstd, one folder per season, and the summary as JSON.

    Rows are brought together by season and then divided by size: small seasons are one
    file each and a season with a third of the table many, so files follow the bytes and not
    the number of tasks. Sizes are those that adaptive execution measures in the shuffle.
    """
    rows = f"{dest.rstrip('/')}/panel"
    gathered = panel.hint("rebalance", season)
    sized = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(file_bytes)}
    with settings(panel.sparkSession, sized):
        gathered.write.option("compression", "zstd").partitionBy(season).mode("errorifexists").parquet(rows)
    summary.write.mode("errorifexists").json(f"{dest.rstrip('/')}/panel_summary")
    return rows


def read(spark: SparkSession, dest: str) -> DataFrame:
    return spark.read.parquet(f"{dest.rstrip('/')}/panel")
