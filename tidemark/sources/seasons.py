"""Season folders of drifting CSV files.

Layout: ``<root>/<season>/<relative file>``, where each entry may be one file or a
folder of part files. Everything is read as strings; types are settled later, once,
by ``operators.clean``.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.classes import FOOTBALL, ColumnClasses
from tidemark.sources import digests, records

UTF8, LATIN1 = "utf-8", "latin-1"
_SPARK_CHARSET = {UTF8: "UTF-8", LATIN1: "ISO-8859-1"}


def csv_path(root: str, season: str, relative: str) -> str:
    return f"{root.rstrip('/')}/{season}/{relative}"


def _located(path: Column, files: Sequence[str]) -> tuple[Column, Column]:
    """(season, relative file) from a path; null where it is neither."""
    names = "|".join(f.replace(".", "[.]") for f in files)
    pattern = rf"/([^/]+)/({names})(?:/[^/]+)?$"
    season = F.regexp_extract(path, pattern, 1)
    relative = F.regexp_extract(path, pattern, 2)
    return F.nullif(season, F.lit("")), F.nullif(relative, F.lit(""))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file under ``root``: path and length. File contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob).load(root).select("path", "length")


def found_files(
    spark: SparkSession, root: str, files: Sequence[str] = tuple(fixed_values.SEASON_FILES)
) -> DataFrame:
    """season, file, parts, bytes and sha256 of what is there."""
    season, relative = _located(F.col("path"), files)
    parts = F.sort_array(F.collect_list(F.struct("path", "digest")))["digest"]
    return (
        digests.file_digests(spark, root, "*.csv")
        .select(season.alias("season"), relative.alias("file"), "path", "length", "digest")
        .where(F.col("file").isNotNull())
        .groupBy("season", "file")
        .agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"), parts.alias("_all"))
        .select(
            "season", "file", "parts", "bytes",
            F.when(F.size("_all") == 1, F.col("_all")[0])
            .otherwise(F.sha2(F.array_join("_all", ""), 256)).alias("sha256"),
        )
    )


def listed_files(spark: SparkSession, root: str, files: Sequence[str]) -> DataFrame:
    """season and file of what is there, from the listing alone."""
    season, relative = _located(F.col("path"), files)
    found = listing(spark, root, "*.csv").select(season.alias("season"), relative.alias("file"))
    return found.where(F.col("file").isNotNull()).distinct()


def source_inventory(
    spark: SparkSession,
    root: str,
    seasons: Sequence[str],
    files: Sequence[str] = tuple(fixed_values.SEASON_FILES),
) -> DataFrame:
    """One row per expected season and file, found or missing.

    A missing file is a fact about its season, not an error. ``sha256`` is the digest of
    the parts' digests in path order, or of a single file itself; large files have a root
    over their lines instead (``digests.file_digests``).
    """
    expected = spark.createDataFrame(
        [(s, f) for s in seasons for f in files], "season string, file string"
    )
    found = found_files(spark, root, files)
    return expected.join(found, ["season", "file"], "left").select(
        "season",
        "file",
        F.when(F.col("parts").isNotNull(), "ok").otherwise("missing").alias("status"),
        F.coalesce("parts", F.lit(0)).alias("parts"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        "sha256",
    )


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )


def detect_formats(spark: SparkSession, root: str, seasons: Sequence[str], file: str) -> DataFrame:
    """season, encoding and multi_line, from one pass over the lines of its files.

    The encoding is UTF-8 if every line is valid, else latin-1. A field with a line
    break in it leaves a line on which a quote stays open. Lines keep their bytes as
    stored and are tested on split files; no file is ever held whole.
    """
    lines = spark.read.text([csv_path(root, s, file) for s in seasons])
    season, _ = _located(F.col("_metadata.file_path"), [file])
    return (
        lines.select(
            season.alias("season"), F.is_valid_utf8("value").alias("valid"),
            records.ends_open(F.col("value")).alias("open"),
        )
        .groupBy("season")
        .agg(
            F.when(F.bool_and("valid"), UTF8).otherwise(LATIN1).alias("encoding"),
            F.bool_or("open").alias("multi_line"),
        )
    )


def detect_encodings(spark: SparkSession, root: str, seasons: Sequence[str], file: str) -> DataFrame:
    """season and encoding of ``detect_formats``."""
    return detect_formats(spark, root, seasons, file).select("season", "encoding")


def read_csv(
    spark: SparkSession, path: str, encoding: str = UTF8, *, multi_line: bool = False,
    place: str | None = None,
) -> DataFrame:
    """All strings, header names trimmed; extra fields dropped, short rows padded.

    With ``multi_line`` quoted fields may hold line breaks: records are then put
    together from the lines of split files. ``place`` adds a column that orders the rows
    of a file.
    """
    charset = _SPARK_CHARSET[encoding]
    if multi_line:
        raw = records.read_csv(spark, path, charset, place or "_place")
        raw = raw if place else raw.drop("_place")
    else:
        raw = (
            spark.read.option("header", True)
            .option("encoding", charset)
            .option("escape", '"')
            .csv(path)
        )
        if place:
            at = ("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
            raw = raw.select("*", F.struct(*at).alias(place))
    return raw.toDF(*[c.strip() for c in raw.columns])


def read_season(
    spark: SparkSession,
    root: str,
    season: str,
    encoding: str = UTF8,
    *,
    file: str = fixed_values.PERIOD_FILE,
    classes: ColumnClasses = FOOTBALL,
    multi_line: bool = False,
) -> DataFrame:
    """One season's rows. Unclassified columns stop the read before any job runs."""
    frame = read_csv(spark, csv_path(root, season, file), encoding, multi_line=multi_line)
    classes.check(frame.columns)
    return frame.withColumn("season", F.lit(season))


def read_bridge(
    spark: SparkSession,
    root: str,
    seasons: Sequence[str],
    encodings: dict[str, str] | None = None,
    *,
    file: str = fixed_values.BRIDGE_FILE,
    multi_line: Collection[str] = (),
) -> DataFrame:
    """season, element, code. Of two rows for one id, the later in the file counts."""
    parts = []
    for season in seasons:
        encoding = (encodings or {}).get(season, UTF8)
        path = csv_path(root, season, file)
        frame = read_csv(spark, path, encoding, multi_line=season in multi_line, place="_at")
        if {"id", "code"} <= set(frame.columns):
            # The later of two rows by its place; a season's places are of one shape.
            parts.append(
                frame.select("id", "code", "_at").dropna(subset=["id", "code"])
                .groupBy(F.col("id").alias("element"))
                .agg(F.max_by("code", "_at").alias("code"))
                .select(F.lit(season).alias("season"), "element", "code")
            )
    if not parts:
        return spark.createDataFrame([], "season string, element string, code string")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def season_notes(
    spark: SparkSession, notes: dict[str, str] | None = None
) -> DataFrame:
    """season, note. Notes label seasons; they are never used to drop one."""
    table = fixed_values.SEASON_NOTES if notes is None else notes
    return spark.createDataFrame(list(table.items()), "season string, note string")
