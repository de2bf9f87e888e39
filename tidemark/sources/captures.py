"""Capture runs: folders of gzip JSON documents with a plain manifest.

Readers cover all runs under a root at once and return one row per document, with
the run taken from the path. The functions below them take such tables, so they
work the same on documents that were compacted to Parquet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.functions import scalars
from tidemark.sources import digests
from tidemark.sources.seasons import listing

EVENT = "struct<id:bigint,deadline_time:string,is_current:boolean,is_next:boolean>"
ELEMENT = (
    "struct<id:bigint,code:bigint,first_name:string,second_name:string,element_type:bigint,"
    "team:bigint,selected_by_percent:string,now_cost:bigint,transfers_in_event:bigint,"
    "transfers_out_event:bigint,ep_next:string,status:string,"
    "chance_of_playing_next_round:bigint,news:string>"
)
BOOTSTRAP = (
    f"events array<{EVENT}>, elements array<{ELEMENT}>, "
    "element_types array<struct<id:bigint,singular_name_short:string>>, "
    "teams array<struct<id:bigint,name:string>>, total_players bigint"
)
SUMMARY = (
    "history array<map<string,string>>, "
    "history_past array<struct<season_name:string,total_points:string>>"
)
MANIFEST = (
    "schema_version int, captured_at string, completed_at string, run_directory string, "
    "include_players boolean, "
    "gameweek struct<current_event:bigint,next_event:bigint,next_deadline:string>, "
    "counts struct<ok:bigint,failed:bigint>, "
    "entries array<struct<url:string,status:int,path:string,error:string,bytes:bigint,"
    "sha256:string>>"
)


def _read(spark: SparkSession, path: str, schema: str, run_pattern: str) -> DataFrame:
    """One JSON document per file. A damaged one keeps its text in ``_corrupt_record``."""
    documents = (
        spark.read.schema(schema + ", _corrupt_record string")
        .option("multiLine", True)
        .json(path)
    )
    return documents.withColumn(
        "run", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1)
    )


def read_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/*/{fixed_values.BOOTSTRAP_FILE}"
    return _read(spark, path, BOOTSTRAP, r"([^/]+)/[^/]+$")


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """run, element, history, history_past; entities without a file are just absent."""
    path = f"{root.rstrip('/')}/*/{fixed_values.SUMMARY_FILES}"
    element = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)[.]json", 1)
    found = _read(spark, path, SUMMARY, r"([^/]+)/[^/]+/[^/]+$")
    return found.withColumn("element", element.cast("bigint"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/*/{fixed_values.MANIFEST_FILE}"
    return _read(spark, path, MANIFEST, r"([^/]+)/[^/]+$")


def payload_digests(spark: SparkSession, root: str, small: int = digests.SMALL) -> DataFrame:
    """run, path, bytes, sha256 of every stored payload, as it was before gzip.

    Files of up to ``small`` packed bytes are read whole, as text, because that reader
    unpacks by extension and keeps the bytes as they are. Larger ones are read by line and
    have ``tree:`` and a root over their lines (``digests.tree_of_lines``); bytes then leave
    out the line ends.
    """
    packed = {"recursiveFileLookup": "true", "pathGlobFilter": "*.gz"}
    base = re.escape(root.rstrip("/").split(":")[-1])
    size = F.col("_metadata.file_size")
    whole = spark.read.options(**packed).text(root, wholetext=True).where(size <= small).select(
        F.col("_metadata.file_path").alias("file"), F.octet_length("value").cast("bigint").alias("bytes"),
        scalars.sha256_hex(F.col("value").cast("binary")).alias("sha256"))
    if not listing(spark, root, "*.gz").where(F.col("length") > small).isEmpty():
        tree = digests.tree_of_lines(digests.lines_of(spark, root, size > small, **packed))
        whole = whole.unionByName(tree.select("file", "bytes", F.concat(F.lit("tree:"), "root").alias("sha256")))
    place = F.regexp_extract("file", rf"{base}/(.*)$", 1)
    return whole.select(
        F.substring_index(place, "/", 1).alias("run"), F.regexp_replace(place, "^[^/]+/", "").alias("path"), "bytes", "sha256")


def unreadable(documents: DataFrame) -> DataFrame:
    """Damaged documents per run."""
    return documents.groupBy("run").agg(F.count("_corrupt_record").alias("unreadable"))


def in_run_order(runs: DataFrame) -> DataFrame:
    """Oldest first; runs of one second by their number, so .2 comes before .10."""
    return runs.orderBy(
        scalars.run_moment(F.col("run")), scalars.run_attempt(F.col("run")), "run"
    )


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """run, files, bytes for every run folder, oldest first."""
    base = re.escape(root.rstrip("/").split(":")[-1])
    run = F.regexp_extract("path", rf"{base}/([^/]+)/", 1)
    return in_run_order(
        listing(spark, root)
        .select(run.alias("run"), "length")
        .where(F.col("run") != "")
        .groupBy("run")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def summary_files(spark: SparkSession, root: str) -> DataFrame:
    """run and path of every per-entity document, from names alone: none is opened."""
    base = re.escape(root.rstrip("/").split(":")[-1])
    folder, _, names = fixed_values.SUMMARY_FILES.partition("/")
    found = listing(spark, root, names).where(F.col("path").rlike(rf"{base}/[^/]+/{folder}/[^/]+$"))
    return found.select(F.regexp_extract("path", rf"{base}/([^/]+)/", 1).alias("run"), "path")


def newest_full_run(summaries: DataFrame) -> DataFrame:
    """The latest run that has per-entity documents, as a one-row table.

    Takes documents or, which opens none, ``summary_files``.
    """
    run = F.col("run")
    order = F.struct(scalars.run_moment(run), scalars.run_attempt(run), run)
    return summaries.groupBy().agg(F.max_by("run", order).alias("run")).where("run is not null")


def capture_log(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per run: current period, ok and failed counts; unreadable manifests show as such."""
    known = manifests.where(F.col("counts").isNotNull()).select(
        "run",
        F.col("gameweek.current_event").alias("current_event"),
        F.col("counts.ok").alias("ok"),
        F.col("counts.failed").alias("failed"),
    )
    return runs.select("run").join(known, "run", "left").select(
        "run", F.col("ok").isNotNull().alias("readable"), "current_event", "ok", "failed"
    )


def manifest_counts(entries: DataFrame) -> DataFrame:
    """Per run: entries that landed and entries that failed."""
    return entries.groupBy("run").agg(
        F.count_if(F.col("path").isNotNull()).alias("ok"),
        F.count_if(F.col("path").isNull()).alias("failed"),
    )


def manifest_document(entries: DataFrame) -> DataFrame:
    """Counts plus the run's entries as one list in url order.

    This is the manifest as a document, so a run's entries meet in one row: use
    it for capture runs (hundreds of entries), and ``manifest_counts`` on
    anything larger.
    """
    rest = [c for c in entries.columns if c not in ("run", "url")]
    listed = entries.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("url", *rest))).alias("entries")
    )
    return manifest_counts(entries).join(listed, "run")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    return manifests.select("run", F.inline("entries"))


def usable(manifests: DataFrame, url: str) -> DataFrame:
    """run, usable: did the first entry for ``url`` land?"""
    entry = scalars.first_where(F.col("entries"), lambda e: e["url"] == url)
    landed = F.coalesce(entry["path"].isNotNull(), F.lit(False))
    return manifests.select("run", landed.alias("usable"))


def _flagged(flag: str) -> Column:
    return scalars.first_where(F.col("events"), lambda e: e[flag])


def period_context(bootstrap: DataFrame) -> DataFrame:
    """run, current and next period, next deadline; nulls where there is none."""
    return bootstrap.select(
        "run",
        _flagged("is_current")["id"].alias("current_event"),
        _flagged("is_next")["id"].alias("next_event"),
        _flagged("is_next")["deadline_time"].alias("next_deadline"),
    )


def next_period(bootstrap: DataFrame) -> DataFrame:
    """One row per run that has a period still to come."""
    return bootstrap.select("run", _flagged("is_next").alias("event")).where(
        F.col("event").isNotNull()
    ).select("run", "event.id", "event.deadline_time")


def listed_entities(bootstrap: DataFrame) -> DataFrame:
    return bootstrap.select("run", F.explode("elements").alias("e")).select(
        "run", F.col("e.id").alias("element")
    )


def season_column(strict: bool = False) -> Column:
    """Season of the earliest deadline; ``strict`` fails where no period has one."""
    deadlines = F.filter(
        F.transform("events", lambda e: scalars.blank_to_null(e["deadline_time"])),
        lambda d: d.isNotNull(),
    )
    label = scalars.season_of_year(F.substring(F.array_min(deadlines), 1, 4).cast("int"))
    known = F.array_size(deadlines) > 0
    if strict:
        return F.when(known, label).otherwise(F.raise_error(F.lit("no deadline in any period")))
    return F.when(known, label)


def season_label(bootstrap: DataFrame, strict: bool = False) -> DataFrame:
    return bootstrap.select("run", season_column(strict).alias("season"))


def entity_columns(element: Column) -> list[Column]:
    """Permanent code, name, group, team and season id of one listed entity.

    The labels sit in the same document, in arrays of a few dozen entries, so
    looking them up there needs no join.
    """
    kind = scalars.first_where(F.col("element_types"), lambda t: t["id"] == element["element_type"])
    team = scalars.first_where(F.col("teams"), lambda t: t["id"] == element["team"])
    return [
        element["code"].cast("string").alias("code"),
        scalars.full_name(element["first_name"], element["second_name"]).alias("name"),
        kind["singular_name_short"].alias("position"),
        team["name"].alias("team"),
        element["id"].cast("string").alias("element"),
    ]


def entity_dimension(bootstrap: DataFrame) -> DataFrame:
    listed = bootstrap.select(
        "run", "element_types", "teams", season_column().alias("season"),
        F.explode("elements").alias("_e"),
    )
    return listed.select("run", "season", *entity_columns(F.col("_e")))
