"""The append-only prediction log.

Layout: ``<root>/predictions/attempt=A/season=S/gameweek=gwNN/model=M`` holds the rows of one
try to log, Parquet; ``<root>/manifest/<number>.json`` is a commit (``plans.commits``): one
line for each season, period and model it adds, which names the attempt. Rows go first and
the commit last, so what a try that broke off has left behind is never read. A commit is
refused if one before it holds a model of the same period, also one that another writer
made in the meantime. Readers take a snapshot, the newest commit or one they name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import ranks
from tidemark.plans import commits

SCHEMA_VERSION = 1

MANIFEST = (
    "schema_version int, season string, gameweek string, model string, deadline timestamp, "
    "capture string, code_version string, context string, rows bigint, digest string, "
    "made_at timestamp, attempt string"
)

# Types of the logged columns; those a model does not have are null when read.
ROW_TYPES = {"value": "double", "prediction": "double", "rank": "int"}
ROWS = ", ".join(f"{c} {ROW_TYPES.get(c, 'string')}" for c in fixed_values.PREDICTION_COLUMNS)
PLACE = "season string, gameweek string, model string"
PLACE_KEYS = ["season", "gameweek", "model"]


def _folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


def instant(text: str) -> datetime:
    """A deadline as an instant; text without an offset is UTC."""
    moment = datetime.fromisoformat(text)
    return moment if moment.tzinfo else moment.replace(tzinfo=UTC)


def guard_deadline(deadline: str | None, now: datetime | None = None) -> None:
    """Refuse once the deadline is past; without one there is nothing to guard."""
    if deadline is not None and (now or datetime.now(UTC)) > instant(deadline):
        raise ValueError(f"deadline {deadline} has passed: rows made now are no forecast")


def snapshot(spark: SparkSession, root: str) -> int:
    """The number of the newest commit; later ones do not change what it holds."""
    return commits.newest(spark, _folder(root, "manifest"))


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row per logged model, with when its period was first written to."""
    entries = commits.entries(spark, _folder(root, "manifest"), MANIFEST, version)
    period = Window.partitionBy("season", "gameweek")
    return entries.withColumn("first_written_at", F.min("made_at").over(period))


def list_logged(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """season, gameweek of every logged period, oldest first."""
    number = F.regexp_extract("gameweek", r"(\d+)$", 1).cast("int")
    logged = read_manifest(spark, root, version).select("season", "gameweek").distinct()
    return logged.orderBy("season", number)


def read_predictions(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of every logged model; those of attempts without a commit stay out."""
    path = _folder(root, "predictions")
    entries = read_manifest(spark, root, version).select(*PLACE_KEYS, "attempt")
    try:
        rows = spark.read.schema(f"{ROWS}, {PLACE}, attempt string").option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{ROWS}, {PLACE}, attempt string")
    return rows.join(entries, [*PLACE_KEYS, "attempt"], "left_semi").drop("attempt")


def clashing(spark: SparkSession, root: str, places: Collection[tuple], version: int | None = None) -> list[tuple]:
    """Those of (season, gameweek, model) already logged; as many as were asked for at most."""
    if not places:
        return []
    asked = spark.createDataFrame(list(places), PLACE)
    here = read_manifest(spark, root, version).join(F.broadcast(asked), PLACE_KEYS, "left_semi")
    return sorted(tuple(r) for r in here.select(*PLACE_KEYS).distinct().collect())


def content_digest(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows, digest: a fingerprint that does not depend on row or file order.

    Rows are unique (each has its own rank), so equal hashes cannot cancel out.
    """
    columns = sorted(set(rows.columns) - set(by))
    parts = [F.count("*").alias("rows")]
    for salt in ("a", "b", "c", "d"):
        parts.append(F.bit_xor(F.xxhash64(F.lit(salt), *columns)).alias(salt))
    folded = F.concat_ws("|", F.col("rows"), *[F.hex(s) for s in ("a", "b", "c", "d")])
    return rows.groupBy(*by).agg(*parts).select(*by, "rows", F.sha2(folded, 256).alias("digest"))


def output_columns(df: DataFrame) -> list[str]:
    return [c for c in fixed_values.PREDICTION_COLUMNS if c in df.columns]


def ranked_output(predictions: DataFrame, *, group_rows: int | None = None) -> DataFrame:
    """The logged columns, with rank 1 for the highest prediction of each model and period."""
    ranked = ranks.output_rank(predictions, PLACE_KEYS, group_rows=group_rows)
    return ranked.select(
        *[F.col(c).cast(ROW_TYPES.get(c, "string")).alias(c) for c in output_columns(ranked)],
        *PLACE_KEYS,
    )


def write_all(
    spark: SparkSession,
    root: str,
    predictions: DataFrame,
    *,
    capture: str,
    deadlines: Mapping[tuple[str, int], str | None] | None = None,
    context: Mapping[str, object] | None = None,
    code_version: str | None = None,
    now: datetime | None = None,
    group_rows: int | None = None,
) -> int:
    """Log every period and model in one commit, whose number is returned.

    ``predictions`` has season, gameweek (a number), model, code and prediction at least;
    ``deadlines`` maps (season, gameweek) to a period's deadline. Nothing is written if a
    deadline has passed or a model is logged already, and nothing is committed if another
    writer logs one of them while this one writes.
    """
    named = predictions.withColumns({
        "season": F.col("season").cast("string"),
        "gameweek": F.format_string("gw%02d", F.col("gameweek").cast("int")),
        "model": F.col("model").cast("string"),
    })
    until = {(str(s), f"gw{int(g):02d}"): d for (s, g), d in (deadlines or {}).items()}
    for deadline in until.values():
        guard_deadline(deadline, now)
    # One entry a period and model: names, not rows.
    places = [tuple(r) for r in named.select(*PLACE_KEYS).distinct().collect()]
    _refuse(clashing(spark, root, places))

    attempt = uuid.uuid4().hex
    target = f"{_folder(root, 'predictions')}/attempt={attempt}"
    # Files follow the size of a period and model, not the number of tasks.
    output = ranked_output(named, group_rows=group_rows).hint("rebalance", *PLACE_KEYS)
    output.write.partitionBy(*PLACE_KEYS).mode("errorifexists").parquet(target)
    # Counted and hashed as stored, not as planned.
    stored = spark.read.schema(f"{ROWS}, {PLACE}").parquet(target)
    made_at = datetime.now(UTC)
    lines = []
    # Entries of one commit are a microsecond apart, so that a period has one that was first.
    for at, about in enumerate(content_digest(stored, PLACE_KEYS).orderBy(*PLACE_KEYS).collect()):
        deadline = until.get((about.season, about.gameweek))
        lines.append({
            "schema_version": SCHEMA_VERSION, "season": about.season, "gameweek": about.gameweek, "model": about.model,
            "deadline": instant(deadline).isoformat() if deadline else None, "capture": capture,
            "code_version": code_version, "context": json.dumps(dict(context or {}), default=str, sort_keys=True),
            "rows": about.rows, "digest": about.digest,
            "made_at": (made_at + timedelta(microseconds=at)).isoformat(), "attempt": attempt,
        })
    for deadline in until.values():
        guard_deadline(deadline, now)
    return commits.commit(spark, _folder(root, "manifest"), lines,
                          lambda seen: _refuse(clashing(spark, root, places, seen)))


def _refuse(clashes: list[tuple]) -> None:
    if clashes:
        told = "; ".join(f"the log of {s} {g} holds {m}" for s, g, m in clashes)
        raise FileExistsError(f"{told}: its rows stay as they are")


def write(
    spark: SparkSession,
    root: str,
    *,
    season: str,
    gameweek: int,
    deadline: str | None,
    capture: str,
    predictions: Mapping[str, DataFrame],
    context: Mapping[str, object] | None = None,
    code_version: str | None = None,
    now: datetime | None = None,
    group_rows: int | None = None,
) -> str:
    """Log one period's predictions; refuses late writes and rewrites.

    ``predictions`` maps a model's name to rows with at least code and prediction.
    Adding a model to a period before its deadline is allowed. Both guards run
    before anything is written, and again when it is committed.
    """
    guard_deadline(deadline, now)
    _refuse(clashing(spark, root, [(season, f"gw{gameweek:02d}", m) for m in predictions]))
    rows = None
    for model, frame in predictions.items():
        one = frame.select(
            *[F.col(c).cast(ROW_TYPES.get(c, "string")).alias(c) for c in output_columns(frame)],
            F.lit(season).alias("season"), F.lit(gameweek).alias("gameweek"), F.lit(model).alias("model"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is not None:
        write_all(spark, root, rows, capture=capture, deadlines={(season, gameweek): deadline}, context=context,
                  code_version=code_version, now=now, group_rows=group_rows)
    return root
