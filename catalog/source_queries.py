"""Sources, documents, names, audit, profile and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import documents
from catalog.panel_queries import CROWD_SQL, RULE_SQL
from catalog.registry import ORACLES, query, rounded
from catalog.tables import (
    FEATURE_SQL,
    PANEL_SQL,
    feature_table,
    labelled_suppliers,
    panel,
    supplier_bound,
    table,
)
from tidemark.classes import FOOTBALL
from tidemark.functions import scalars
from tidemark.functions.names import fold_name
from tidemark.operators import audit, baselines, clean, combine, live, profile
from tidemark.plans import audit_report as audit_report_plan
from tidemark.plans import feature_state, forecast, panel_build, prediction_log
from tidemark.session import shared_folder, written
from tidemark.sources import captures, seasons

# --- alignment, coverage, profile -------------------------------------------


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items as two sources of unlike columns."""
    orders = table(spark, sf_dir, "orders").select(
        scalars.season_of_year(F.year("o_orderdate")).alias("season"),
        F.month("o_orderdate").alias("round"),
        F.col("o_custkey").alias("code"),
        F.col("o_orderkey").alias("fixture"),
        F.col("o_totalprice").alias("total_points"),
        F.col("o_orderstatus").alias("status"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        scalars.season_of_year(F.year("l_shipdate")).alias("season"),
        F.month("l_shipdate").alias("round"),
        F.col("l_suppkey").alias("code"),
        F.col("l_orderkey").alias("fixture"),
        F.col("l_quantity").alias("minutes"),
        F.when(F.year("l_shipdate") >= 1998, F.col("l_discount")).alias("expected_goals"),
    )
    return combine.align(
        [combine.tag(orders, "backfill"), combine.tag(lines, "capture")], FOOTBALL
    )


_SEASON = "CAST({y} AS VARCHAR) || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0')"
_MIXED = f"""mixed AS (
      SELECT {_SEASON.format(y='year(o_orderdate)')} AS season,
             CAST(month(o_orderdate) AS INTEGER) AS round, o_custkey AS code,
             o_orderkey AS fixture, o_totalprice AS total_points, o_orderstatus AS status,
             'backfill' AS provenance, CAST(NULL AS DOUBLE) AS minutes,
             CAST(NULL AS DOUBLE) AS expected_goals
      FROM orders
      UNION ALL
      SELECT {_SEASON.format(y='year(l_shipdate)')}, CAST(month(l_shipdate) AS INTEGER),
             l_suppkey, l_orderkey, NULL, NULL, 'capture', l_quantity,
             CASE WHEN year(l_shipdate) >= 1998 THEN l_discount END
      FROM lineitem)"""
_MIXED_COLUMNS = [
    "round", "code", "fixture", "total_points", "status", "provenance", "minutes",
    "expected_goals",
]


@query(f"WITH {_MIXED} SELECT * FROM mixed")
def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(spark, sf_dir)


_COUNTS = " UNION ALL ".join(
    f"SELECT season, '{c}' AS \"column\", count({c}) AS n FROM mixed GROUP BY season"
    for c in _MIXED_COLUMNS
)


@query(
    f"""WITH {_MIXED}, counts AS ({_COUNTS})
    SELECT "column", coalesce(string_agg(season, '|' ORDER BY season) FILTER (WHERE n > 0), '')
      AS seasons FROM counts GROUP BY "column\""""
)
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.coverage(mixed_sources(spark, sf_dir))
    return found.select("column", F.array_join("seasons", "|").alias("seasons"))


_EXPECTED = [f"{y}-{(y + 1) % 100:02d}" for y in range(1994, 2003)]
_DEMO_NOTES = {"1997-98": "late orders", "1999-00": "label of a turn of century"}
_EXPECTED_SQL = (
    "expected AS (SELECT season, note FROM (VALUES "
    + ", ".join(
        f"('{s}', " + (f"'{_DEMO_NOTES[s]}'" if s in _DEMO_NOTES else "CAST(NULL AS VARCHAR)") + ")"
        for s in _EXPECTED
    )
    + ") t(season, note))"
)


def _expected(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame([(s,) for s in _EXPECTED], "season string")
    return asked.join(seasons.season_notes(spark, _DEMO_NOTES), "season", "left")


@query(
    f"""WITH {_MIXED}, {_EXPECTED_SQL},
    held AS (SELECT season, count(*) AS rows, count(DISTINCT round) AS periods
             FROM mixed GROUP BY season)
    SELECT season, note, coalesce(rows, 0) AS rows, coalesce(periods, 0) AS periods,
           CASE WHEN rows IS NULL THEN 'not vendored' ELSE 'ok' END AS status
    FROM expected LEFT JOIN held USING (season)"""
)
def season_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected seasons with notes; two of them have no rows."""
    return profile.season_profile(mixed_sources(spark, sf_dir), _expected(spark))


@query(
    f"""WITH {_MIXED}, {_EXPECTED_SQL}
    SELECT m.season, m.provenance, e.note, count(*) AS rows
    FROM mixed m LEFT JOIN expected e USING (season) GROUP BY ALL"""
)
def season_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keep their season's note beside them; no season is dropped."""
    notes = seasons.season_notes(spark, _DEMO_NOTES)
    labelled = mixed_sources(spark, sf_dir).join(notes, "season", "left")
    return labelled.groupBy("season", "provenance", "note").agg(F.count("*").alias("rows"))


_CLASS_OF = {c: label for label, names in FOOTBALL.report(_MIXED_COLUMNS).items() for c in names}


@query(
    f"WITH {_MIXED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{label}' AS class, count({c}) AS filled FROM mixed"
        for c, label in _CLASS_OF.items()
    )
)
def column_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's class, and how many values of it the table holds."""
    rows = mixed_sources(spark, sf_dir)
    classes = profile.class_report(spark, rows.columns)
    filled = profile.counts_by_season(rows).groupBy("column").agg(F.sum("n").alias("filled"))
    return classes.join(filled, "column")


@query(
    f"""WITH {_MIXED}, {_EXPECTED_SQL}, counts AS ({_COUNTS}),
    held AS (SELECT season, count(*) AS rows, count(DISTINCT round) AS periods
             FROM mixed GROUP BY season),
    cover AS (SELECT "column", coalesce(string_agg(season, '|' ORDER BY season)
              FILTER (WHERE n > 0), '') AS s FROM counts GROUP BY "column")
    SELECT (SELECT count(*) FROM mixed) AS rows, 9 AS columns, 'mixed' AS provenance,
           false AS point_in_time,
           '{','.join(FOOTBALL.report([*_MIXED_COLUMNS, 'season'])['identity'])}' AS identity,
           '{','.join(FOOTBALL.report(_MIXED_COLUMNS)['pre_deadline'])}' AS pre_deadline,
           '{','.join(FOOTBALL.report(_MIXED_COLUMNS)['outcome'])}' AS outcome,
           (SELECT string_agg(season || ':' || coalesce(rows, 0), ',' ORDER BY season)
              FROM expected LEFT JOIN held USING (season)) AS seasons,
           (SELECT string_agg("column" || '=' || s, ',' ORDER BY "column") FROM cover) AS coverage"""
)
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = profile.summary(
        mixed_sources(spark, sf_dir), _expected(spark), provenance="mixed"
    )
    return about.selectExpr(
        "rows", "columns", "provenance", "point_in_time",
        "array_join(column_classes.identity, ',') as identity",
        "array_join(column_classes.pre_deadline, ',') as pre_deadline",
        "array_join(column_classes.outcome, ',') as outcome",
        "array_join(transform(seasons, s -> concat(s.season, ':', s.rows)), ',') as seasons",
        "array_join(transform(coverage, c -> concat(c.column, '=', array_join(c.seasons, '|'))),"
        " ',') as coverage",
    )


# --- joins -------------------------------------------------------------------


@query(
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_orderkey AS element,
      l_linenumber AS line, l_partkey AS part, o_custkey AS code
    FROM lineitem LEFT JOIN orders
      ON o_orderkey = l_orderkey AND year(o_orderdate) = year(l_shipdate)"""
)
def code_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season-local ids to permanent ones; a line shipped in another year has no match."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"),
        F.col("l_orderkey").alias("element"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
    )
    bridge = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season"),
        F.col("o_orderkey").alias("element"),
        F.col("o_custkey").alias("code"),
    )
    return combine.attach_code(lines, bridge)


@query(
    """SELECT c_custkey, n_name AS team FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 100 ELSE 0 END"""
)
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id to label; every fifth customer has an id that no nation has, and gets null."""
    labels = table(spark, sf_dir, "nation")
    moved = F.when(F.col("c_custkey") % 5 == 0, F.lit(100)).otherwise(F.lit(0))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") + moved).alias("c_nationkey")
    )
    found = combine.attach_label(rows, labels, "c_nationkey", "n_nationkey", "n_name", "team")
    return found.select("c_custkey", "team")


# --- cleaning and scalars ----------------------------------------------------


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text rows with the faults cleaning has to deal with."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "case event_type when 'error' then 'AM' when 'view' then 'GKP' when 'signup' then null "
        "else upper(event_type) end as position",
        "cast(nullif(user_id, 8) as string) as code",
        "case when user_id = 46 then null else concat(' ', month(ts), ' ') end as round",
        "case event_type when 'click' then concat(cast(event_id as string), 'd') "
        "when 'purchase' then 'n/a' else cast(event_id as string) end as total_points",
        "cast(event_id as string) as minutes",
    )


@query(
    """SELECT event_id,
      CASE event_type WHEN 'view' THEN 'GK' ELSE upper(event_type) END AS position,
      CAST(user_id AS VARCHAR) AS code, CAST(month(ts) AS DOUBLE) AS round,
      CASE WHEN event_type IN ('click', 'purchase') THEN NULL
           ELSE CAST(event_id AS DOUBLE) END AS total_points,
      CAST(event_id AS DOUBLE) AS minutes
    FROM events WHERE event_type NOT IN ('error', 'signup') AND user_id NOT IN (8, 46)"""
)
def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare(_raw_events(spark, sf_dir))


@query(
    """SELECT CAST(year(ts) AS INTEGER) AS season, count(*) AS rows,
      count(*) FILTER (WHERE event_type = 'signup') AS no_group,
      count(*) FILTER (WHERE event_type = 'error') AS dropped_group,
      count(*) FILTER (WHERE user_id = 8) AS no_entity
    FROM events GROUP BY 1"""
)
def dropped_rows_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_events(spark, sf_dir)
    dated = table(spark, sf_dir, "events").select("event_id", F.year("ts").alias("season"))
    return clean.dropped_by_season(raw.join(dated, "event_id"))


@query(
    """SELECT o_orderkey,
      CAST(year(o_orderdate) AS VARCHAR) || '-'
        || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season,
      'gw' || CASE WHEN o_orderkey < 10 THEN '0' ELSE '' END || o_orderkey AS label,
      trim(o_orderpriority || ' ' || o_orderstatus) AS full_name,
      CAST(floor(month(o_orderdate) / 100.0 * o_custkey) AS BIGINT) AS owners,
      coalesce(nullif(o_custkey, 1), 0) - coalesce(nullif(o_orderkey, 2), 0) AS net,
      nullif(o_orderstatus, 'F') AS status_or_null,
      strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') AS run,
      CAST(epoch(o_orderdate) AS BIGINT) AS moment,
      CAST(o_orderkey AS INTEGER) AS attempt,
      sha256(o_orderpriority) AS digest
    FROM orders"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    run = scalars.run_name(F.col("o_orderdate"))
    numbered = F.concat(run, F.lit("."), F.col("o_orderkey").cast("string"))
    slashed = F.replace(scalars.season_of_year(F.year("o_orderdate")), F.lit("-"), F.lit("/"))
    return orders.select(
        "o_orderkey",
        scalars.dashed_season(slashed).alias("season"),
        scalars.period_label(F.col("o_orderkey")).alias("label"),
        scalars.full_name(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("full_name"),
        scalars.owner_count(F.month("o_orderdate"), F.col("o_custkey")).alias("owners"),
        scalars.net(
            F.nullif(F.col("o_custkey"), F.lit(1)), F.nullif(F.col("o_orderkey"), F.lit(2))
        ).alias("net"),
        scalars.blank_to_null(F.translate("o_orderstatus", "F", "")).alias("status_or_null"),
        run.alias("run"),
        F.unix_timestamp(scalars.run_moment(numbered)).alias("moment"),
        scalars.run_attempt(numbered).alias("attempt"),
        scalars.sha256_hex(F.col("o_orderpriority")).alias("digest"),
    )


_FOLD = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  replace(lower(strip_accents(regexp_replace(replace({x}, '_', ' '), '\\s+\\d+(\\n?)$', ''))),
  'đ', 'd'), 'ð', 'd'), 'ł', 'l'), 'ø', 'o'), 'þ', 'th'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'),
  'ı', 'i'), '\\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, {_FOLD.format(x='text')} AS folded FROM documents")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name fold over whole texts in four languages."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", fold_name(F.col("text")).alias("folded")
    )


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def payload_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte count and digest of each body as received."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("bytes"),
        scalars.sha256_hex(F.col("text")).alias("sha256"),
    )


# --- capture documents -------------------------------------------------------

_M = "c_custkey % 13"
_RUN = "'c' || c_custkey"
_YEAR = "(1995 + c_custkey % 6)"
_LABEL = f"CASE WHEN c_custkey % 17 <> 0 THEN {_SEASON.format(y=_YEAR)} END"
_DEADLINE = f"""CASE WHEN c_custkey % 17 <> 0 THEN
      CAST({_YEAR} + (({_M} + 7) // 12) AS VARCHAR) || '-'
      || lpad(CAST(({_M} + 7) % 12 + 1 AS VARCHAR), 2, '0') || '-01T17:30:00Z' END"""


@query(
    f"""SELECT {_RUN} AS run, CASE WHEN {_M} >= 1 THEN {_M} END AS current_event,
      CASE WHEN {_M} <= 11 THEN {_M} + 1 END AS next_event,
      CASE WHEN {_M} <= 11 THEN {_DEADLINE} END AS next_deadline
    FROM customer"""
)
def period_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.period_context(documents.bootstrap_documents(spark, sf_dir))


@query(
    f"""SELECT {_RUN} AS run, {_M} + 1 AS id, {_DEADLINE} AS deadline_time
    FROM customer WHERE {_M} <= 11"""
)
def next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.next_period(documents.bootstrap_documents(spark, sf_dir))


@query(
    f"""SELECT {_RUN} AS run, c_custkey AS element FROM customer
    UNION ALL SELECT {_RUN}, c_custkey + 10000000 FROM customer"""
)
def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.listed_entities(documents.bootstrap_documents(spark, sf_dir))


@query(f"SELECT {_RUN} AS run, {_LABEL} AS season FROM customer")
def season_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.season_label(documents.bootstrap_documents(spark, sf_dir))


_ENTITIES = f"""entities AS (
      SELECT {_RUN} AS run, {_LABEL} AS season, CAST(c_custkey + 1000 AS VARCHAR) AS code,
             trim(split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2)) AS name,
             CASE c_nationkey % 5 WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID'
                  WHEN 4 THEN 'FWD' END AS position,
             n_name AS team, CAST(c_custkey AS VARCHAR) AS element
      FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
      UNION ALL
      SELECT {_RUN}, {_LABEL}, CAST(c_custkey + 20000000 AS VARCHAR), 'Reserve', NULL, NULL,
             CAST(c_custkey + 10000000 AS VARCHAR)
      FROM customer)"""


@query(f"WITH {_ENTITIES} SELECT * FROM entities")
def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.entity_dimension(documents.bootstrap_documents(spark, sf_dir))


_HISTORY = f"""history AS (
      SELECT e.run, e.season, e.code, e.name, e.position, e.team, e.element,
             CAST(month(o_orderdate) AS VARCHAR) AS round,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(day(o_orderdate) * 3 AS VARCHAR) END
               AS minutes,
             CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS total_points,
             CAST(day(o_orderdate) AS VARCHAR) AS value,
             CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS was_home,
             strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
               AS kickoff_time,
             'capture' AS provenance
      FROM orders JOIN entities e ON e.element = CAST(o_custkey AS VARCHAR))"""
_HISTORY_FIELDS = ["round", "minutes", "total_points", "value", "was_home", "kickoff_time"]


@query(f"WITH {_ENTITIES}, {_HISTORY} SELECT * FROM history")
def completed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.completed_history(
        documents.bootstrap_documents(spark, sf_dir),
        documents.summary_documents(spark, sf_dir),
        _HISTORY_FIELDS,
    )


_STUBS = f"""stubs AS (
      SELECT e.*, CAST({_M} + 1 AS VARCHAR) AS round,
             CASE WHEN reserve THEN '40' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END
               AS value,
             CASE WHEN reserve THEN '0' ELSE CAST(CAST(trunc((c_custkey % 1000) / 100.0
                  * (1000 + c_custkey)) AS BIGINT) AS VARCHAR) END AS selected,
             CASE WHEN reserve THEN '0' ELSE CAST(c_custkey % 7 AS VARCHAR) END AS transfers_in,
             CASE WHEN reserve THEN '3' ELSE CAST(c_custkey % 11 AS VARCHAR) END AS transfers_out,
             CASE WHEN reserve THEN '-3' ELSE CAST(c_custkey % 7 - c_custkey % 11 AS VARCHAR) END
               AS transfers_balance,
             CASE WHEN reserve THEN '0.0' ELSE CAST(c_custkey % 9 AS VARCHAR) END AS "xP",
             CASE WHEN NOT reserve THEN lower(substr(c_mktsegment, 1, 1)) END AS status,
             CASE WHEN NOT reserve THEN CAST(25 * (c_custkey % 5) AS VARCHAR) END
               AS chance_of_playing,
             CASE WHEN reserve THEN c_mktsegment END AS news,
             'capture' AS provenance
      FROM (SELECT *, name = 'Reserve' AS reserve FROM entities) e
      JOIN customer ON e.run = {_RUN}
      WHERE {_M} <= 11)"""


@query(f"WITH {_ENTITIES}, {_STUBS} SELECT * EXCLUDE (reserve) FROM stubs")
def upcoming_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.upcoming_stubs(documents.bootstrap_documents(spark, sf_dir))


_LIVE = f"{_ENTITIES}, {_HISTORY}, {_STUBS}"
_LIVE_COLUMNS = [
    "run", "season", "code", "name", "position", "team", "element", "round", "minutes",
    "total_points", "value", "selected", "transfers_balance", "xP", "status", "kickoff_time",
    "provenance",
]


@query(
    f"""WITH {_LIVE} SELECT run, season, code, name, position, team, element, round, minutes,
      total_points, value, NULL AS selected, NULL AS transfers_balance, NULL AS "xP",
      NULL AS status, kickoff_time, provenance FROM history
    UNION ALL SELECT run, season, code, name, position, team, element, round, NULL, NULL, value,
      selected, transfers_balance, "xP", status, NULL, provenance FROM stubs"""
)
def live_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.build(
        documents.bootstrap_documents(spark, sf_dir), documents.summary_documents(spark, sf_dir)
    )
    return rows.select(*_LIVE_COLUMNS)


@query(
    f"""SELECT {_RUN} AS run, {_LABEL} AS season,
      CASE WHEN {_M} <= 11 THEN {_M} + 1 END AS next_gameweek,
      CASE WHEN {_M} <= 11 THEN {_DEADLINE} END AS deadline,
      (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS completed_rows,
      CAST(CASE WHEN {_M} <= 11 THEN 2 ELSE 0 END AS BIGINT) AS upcoming_rows
    FROM customer"""
)
def live_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    bootstrap = forecast.parsed(documents.bootstrap_documents(spark, sf_dir))
    return live.context(bootstrap, documents.summary_documents(spark, sf_dir))


@query(
    f"""WITH {_LIVE},
    rows AS (
      SELECT run, season, code, CASE position WHEN 'GKP' THEN 'GK' ELSE position END AS position,
             CAST(round AS DOUBLE) AS round, CAST(minutes AS DOUBLE) AS minutes,
             CAST(total_points AS DOUBLE) AS total_points, NULL AS selected, NULL AS moved,
             NULL AS xp, kickoff_time
      FROM history
      UNION ALL
      SELECT run, season, code, CASE position WHEN 'GKP' THEN 'GK' ELSE position END,
             CAST(round AS DOUBLE), NULL, NULL, CAST(selected AS DOUBLE),
             CAST(transfers_balance AS DOUBLE), CAST("xP" AS DOUBLE), NULL
      FROM stubs),
    kept AS (SELECT * FROM rows WHERE position IS NOT NULL),
    lags AS (
      SELECT *, avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5,
        avg(minutes) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS minutes5,
        CASE WHEN lag(total_points) OVER w IS NOT NULL THEN sum(total_points)
          OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS points_sum,
        CASE WHEN lag(minutes) OVER w IS NOT NULL THEN sum(minutes)
          OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS minutes_sum
      FROM kept
      WINDOW w AS (PARTITION BY run, season, code ORDER BY round, kickoff_time NULLS FIRST)),
    target AS (
      SELECT l.* FROM lags l JOIN customer ON l.run = {_RUN}
      WHERE {_M} <= 11 AND l.round = {_M} + 1),
    crowd AS (
      SELECT *, rank() OVER (PARTITION BY run, season, round ORDER BY coalesce(selected, 0))
        + (count(*) OVER (PARTITION BY run, season, round, coalesce(selected, 0)) - 1) / 2.0
        + 0.5 * (rank() OVER (PARTITION BY run, season, round ORDER BY coalesce(moved, 0))
        + (count(*) OVER (PARTITION BY run, season, round, coalesce(moved, 0)) - 1) / 2.0)
        AS score
      FROM target)
    SELECT 'rate_x_exposure' AS baseline, run, code, kickoff_time,
      round(coalesce(CASE WHEN minutes_sum > 0 THEN points_sum / minutes_sum * 90 END
            * minutes5 / 90, 0), 6) AS prediction FROM crowd
    UNION ALL SELECT 'rolling_mean5', run, code, kickoff_time, round(coalesce(mean5, 0), 6)
      FROM crowd
    UNION ALL SELECT 'published_forecast', run, code, kickoff_time, round(coalesce(xp, 0), 6)
      FROM crowd
    UNION ALL SELECT 'crowd', run, code, kickoff_time, round(CAST(score AS DOUBLE), 6) FROM crowd"""
)
def forecast_next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's next period under every rule; a run without season keeps its rows."""
    predicted = forecast.next_period_predictions(
        documents.bootstrap_documents(spark, sf_dir), documents.summary_documents(spark, sf_dir)
    )
    return rounded(predicted.select("baseline", "run", "code", "kickoff_time", "prediction"))


@query(f"SELECT * FROM ({ORACLES['forecast_next_period']}) AS forecast WHERE kickoff_time IS NULL")
def forecast_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of what is still to come from a state: folded from the periods of an earlier
    capture, then advanced by one that repeats them and adds the rest."""
    bootstrap = forecast.parsed(documents.bootstrap_documents(spark, sf_dir))
    rows = forecast.live_rows(bootstrap, documents.summary_documents(spark, sf_dir))
    history, target = forecast.split_at_deadline(rows, bootstrap)
    how = feature_state.FeatureState(forecast.RUN_SPEC)
    earlier = written(how.fold(history.where(F.col("round") < 6)), "state")
    predicted = forecast.predictions_from_state(how.advance(earlier, history), target).where("kickoff_time is null")
    return rounded(predicted.select("baseline", "run", "code", "kickoff_time", "prediction"))


_MANIFEST_RUN = "strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '.' || event_id"


@query(
    f"""SELECT {_MANIFEST_RUN} AS run, event_type NOT IN ('error', 'click') AS usable FROM events"""
)
def usable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry for the bootstrap url decides, even if a later one landed."""
    return captures.usable(
        documents.manifest_documents(spark, sf_dir), documents.BOOTSTRAP_URL
    )


@query(
    f"""SELECT {_MANIFEST_RUN} AS run, event_type <> 'click' AS readable,
      CASE WHEN event_type <> 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END
        AS current_event,
      CAST(CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 2 ELSE 3 END AS BIGINT) AS ok,
      CAST(CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 1 ELSE 0 END AS BIGINT)
        AS failed
    FROM events"""
)
def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = documents.manifest_documents(spark, sf_dir)
    return captures.capture_log(manifests.select("run"), manifests)


@query(
    f"""SELECT {_MANIFEST_RUN} AS run,
      CAST(CASE event_type WHEN 'error' THEN 2 ELSE 3 END AS BIGINT) AS ok,
      CAST(CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS BIGINT) AS failed
    FROM events WHERE event_type <> 'click'"""
)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = captures.manifest_entries(documents.manifest_documents(spark, sf_dir))
    return captures.manifest_counts(entries)


@query(
    f"""SELECT {_MANIFEST_RUN} AS run FROM events WHERE event_type <> 'click'
    ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 1"""
)
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest by instant, then by number: .10 is later than .9."""
    manifests = documents.manifest_documents(spark, sf_dir)
    return captures.newest_full_run(manifests.where(F.col("counts").isNotNull()))


# --- audit -------------------------------------------------------------------


def audit_panel(spark: SparkSession, sf_dir: str, coded: bool = True) -> DataFrame:
    """A panel of all orders, of which open ones have no total yet, so that some disagree."""
    orders = table(spark, sf_dir, "orders")
    settled = F.col("o_orderstatus") != "P"
    customer = table(spark, sf_dir, "customer")
    code = (F.col("o_custkey") + 1000).cast("string") if coded else F.lit(None).cast("string")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        scalars.season_of_year(F.year("o_orderdate")).alias("season"),
        code.alias("code"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit("_")).alias("name"),
        F.when(settled, F.floor("o_totalprice")).cast("string").alias("total_points"),
    )


_YEAR_LABEL = _SEASON.format(y="year(o_orderdate)")
_DERIVED = f"""derived AS (
      SELECT {_YEAR_LABEL} AS season, CAST(o_custkey + 1000 AS VARCHAR) AS code,
             CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS backfill_points
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)"""
_OFFICIAL = f"""official AS (
      SELECT 'c' || o_custkey AS run, CAST(o_custkey + 1000 AS VARCHAR) AS code,
             trim({_FOLD.format(x="replace(c_name, '#', ' ')")}) AS name_n,
             {_YEAR_LABEL} AS season,
             CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS official_points
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query(f"WITH {_DERIVED} SELECT * FROM derived")
def derived_totals_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.derived_totals(audit_panel(spark, sf_dir))


@query(
    f"""SELECT {_YEAR_LABEL} AS season, lower(split_part(c_name, '#', 1)) AS name_n,
      CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS backfill_points,
      count(DISTINCT c_name) AS spellings
    FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus <> 'P' GROUP BY ALL"""
)
def derived_totals_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing number counts as an id and goes, so all spellings meet in one name."""
    return audit.derived_totals(audit_panel(spark, sf_dir), by="name")


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.official_totals(
        documents.bootstrap_documents(spark, sf_dir), documents.yearly_records(spark, sf_dir)
    )


@query(f"WITH {_OFFICIAL} SELECT * FROM official")
def official_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _official(spark, sf_dir)


@query(
    f"""WITH {_DERIVED}, {_OFFICIAL}
    SELECT count(*) AS matched, count(*) FILTER (WHERE official_points = backfill_points) AS agreed,
      round(count(*) FILTER (WHERE official_points = backfill_points) / count(*), 4)
        AS agreement_rate,
      CASE WHEN count(*) = 0 THEN 'nothing matched' END AS note
    FROM official JOIN derived USING (season, code)"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = audit.matched_totals(_official(spark, sf_dir), audit_panel(spark, sf_dir))
    return audit.agreement(matched)


@query(
    f"""WITH {_DERIVED}, {_OFFICIAL}
    SELECT code AS player, season, official_points AS official, backfill_points AS backfill
    FROM official JOIN derived USING (season, code)
    WHERE official_points <> backfill_points ORDER BY season, code LIMIT 50"""
)
def audit_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's list: the first fifty differing totals."""
    matched = audit.matched_totals(_official(spark, sf_dir), audit_panel(spark, sf_dir), "code")
    return audit.disagreements(matched)


@query(
    f"""WITH {_OFFICIAL}, by_name AS (
      SELECT {_YEAR_LABEL} AS season, lower(split_part(c_name, '#', 1)) AS name_n,
             sum(CAST(floor(o_totalprice) AS BIGINT)) AS backfill_points
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT count(*) AS matched, count(*) FILTER (WHERE official_points = backfill_points) AS agreed,
      round(count(*) FILTER (WHERE official_points = backfill_points) / count(*), 4)
        AS agreement_rate,
      CASE WHEN count(*) = 0 THEN 'nothing matched' END AS note
    FROM official JOIN by_name USING (season, name_n)"""
)
def audit_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without codes the audit falls back to folded names, and shows what that costs."""
    matched = audit.matched_totals(
        _official(spark, sf_dir), audit_panel(spark, sf_dir, coded=False)
    )
    return audit.agreement(matched)


@query(
    f"""WITH {_DERIVED}, {_OFFICIAL}, runs AS (
      SELECT * FROM official UNION ALL SELECT * REPLACE (run || '.2' AS run) FROM official)
    SELECT run, count(*) AS matched, count(*) FILTER (WHERE official_points = backfill_points) AS agreed,
      round(count(*) FILTER (WHERE official_points = backfill_points) / count(*), 4)
        AS agreement_rate, CAST(NULL AS VARCHAR) AS note
    FROM runs JOIN derived USING (season, code) GROUP BY run"""
)
def audit_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity captured in two runs; each run is counted on its own."""
    matched = audit.matched_totals(_twice(_official(spark, sf_dir)), audit_panel(spark, sf_dir))
    return audit.agreement(matched, ["run"])


def _twice(df: DataFrame) -> DataFrame:
    return df.unionByName(df.withColumn("run", F.concat("run", F.lit(".2"))))


@query(
    f"""WITH {_DERIVED}, {_OFFICIAL}, newest AS (SELECT max(run || '.2') AS run FROM official)
    SELECT (SELECT run FROM newest) AS run, count(*) AS matched,
      count(*) FILTER (WHERE official_points = backfill_points) AS agreed,
      round(count(*) FILTER (WHERE official_points = backfill_points) / count(*), 4)
        AS agreement_rate,
      CASE WHEN count(*) = 0 THEN 'nothing matched' END AS note
    FROM official JOIN derived USING (season, code)
    WHERE run || '.2' = (SELECT run FROM newest)"""
)
def audit_newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit plan: the newest of all runs, of which each entity has two."""
    return audit_report_plan.compare(
        audit_panel(spark, sf_dir),
        _twice(documents.bootstrap_documents(spark, sf_dir)),
        _twice(documents.yearly_records(spark, sf_dir)),
    ).report


# --- sinks and round trips ---------------------------------------------------


@query(f"WITH {PANEL_SQL} SELECT * FROM panel")
def panel_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel through its Parquet sink, partitioned by season."""
    rows = panel(spark, sf_dir)
    expected = rows.select("season").distinct()
    about = profile.summary(rows, expected, provenance="backfill")
    dest = shared_folder(spark, "panel")
    panel_build.write(rows, about, dest)
    return panel_build.read(spark, dest).select(*rows.columns)


def _write_season_folders(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """Season CSV folders as a collector would leave them: drifting and in two encodings."""
    root = shared_folder(spark, "seasons")
    stored = f"{shared_folder(spark, 'panel')}"
    panel(spark, sf_dir).select(
        "season", "round", F.col("code").alias("element"),
        F.concat("name", F.when(F.col("season") % 2 == 0, "\n").otherwise(" "), F.lit("é")).alias("name"),
        "position", "total_points", "minutes", "value", "xP",
    ).write.partitionBy("season").parquet(stored)
    rows = spark.read.parquet(stored)
    years = sorted(r.season for r in rows.select("season").distinct().collect())
    labels = []
    for year in years:
        label, old = f"{year}-{(year + 1) % 100:02d}", year < 1998
        # The forecast column exists in later seasons only, and headers carry blanks.
        season = rows.where(F.col("season") == year).drop("season", *(["xP"] if old else []))
        season = season.withColumnRenamed("minutes", " minutes ")
        writer = season.write.option("header", True).option("quoteAll", True)
        writer = writer.option("encoding", "ISO-8859-1" if old else "UTF-8")
        writer.csv(seasons.csv_path(root, label, "gws/merged_gw.csv"))
        ids = labelled_suppliers(spark, sf_dir).where(F.col("value").isNotNull())
        ids.select(
            F.col("code").alias("id"), (F.col("code") + 200000).alias("code"), "name"
        ).write.option("header", True).csv(seasons.csv_path(root, label, "players_raw.csv"))
        labels.append(label)
    return root, labels


@query(
    f"""WITH {PANEL_SQL}
    SELECT CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')
        AS season,
      CAST(round AS VARCHAR) AS round, CAST(code AS VARCHAR) AS element,
      name || CASE WHEN season % 2 = 0 THEN chr(10) ELSE ' ' END || 'é' AS name,
      position, CAST(total_points AS DOUBLE) AS total_points, CAST(minutes AS DOUBLE) AS minutes,
      value, CASE WHEN season >= 1998 THEN "xP" END AS "xP",
      CASE WHEN value IS NOT NULL THEN CAST(code + 200000 AS VARCHAR) END AS code,
      'backfill' AS provenance
    FROM panel"""
)
def panel_from_season_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV seasons in two encodings, with drifting headers, back to one panel.

    Names of every other season hold a line break inside their quotes.
    """
    root, labels = _write_season_folders(spark, sf_dir)
    built = panel_build.build(spark, root, labels)
    return clean.cast_numeric(built.rows, ["total_points", "minutes", "value", "xP"])


@query(
    """WITH years AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem),
    labels AS (SELECT CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
                 AS season, y FROM years),
    files AS (SELECT * FROM (VALUES ('gws/merged_gw.csv', 'ok'), ('fixtures.csv', 'missing'),
              ('teams.csv', 'missing'), ('players_raw.csv', 'ok')) t(file, status))
    SELECT season, file, status,
           CASE WHEN file <> 'gws/merged_gw.csv' THEN NULL
                WHEN y < 1998 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
           status = 'ok' AS digested
    FROM labels CROSS JOIN files"""
)
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each season folder holds, what it lacks, and how its text is encoded."""
    root, labels = _write_season_folders(spark, sf_dir)
    found = seasons.source_inventory(spark, root, labels)
    spelled = seasons.detect_encodings(spark, root, labels, "gws/merged_gw.csv").withColumn(
        "file", F.lit("gws/merged_gw.csv")
    )
    # Sizes and digests follow the writer's settings; that they are there is told here.
    whole = (F.col("parts") > 0) & (F.col("bytes") > 0) & (F.length("sha256") == 64)
    return found.join(spelled, ["season", "file"], "left").select(
        "season", "file", "status", "encoding", F.coalesce(whole, F.lit(False)).alias("digested")
    )


def _logged_periods(spark: SparkSession, sf_dir: str) -> str:
    """Log all rules for all periods in one commit; returns the log's root."""
    rows = supplier_bound(spark, sf_dir)
    predicted = baselines.predict_all(feature_table(spark, sf_dir), group_rows=rows)
    root = shared_folder(spark, "log")
    prediction_log.write_all(
        spark,
        root,
        predicted.withColumns({"model": F.col("baseline"), "gameweek": F.col("round"), "code": F.col("code").cast("string")}),
        capture="suppliers",
        group_rows=rows,
    )
    return root


_EACH_RULE = " UNION ALL ".join(
    f"""SELECT '{rule}' AS model, season, round, CAST(code AS VARCHAR) AS id, name, position, value,
      CAST({expression} AS DOUBLE) AS prediction FROM crowd"""
    for rule, expression in RULE_SQL.items()
)
_LOGGED = f"{FEATURE_SQL}{CROWD_SQL}, logged AS ({_EACH_RULE})"


@query(
    f"""WITH {_LOGGED}
    SELECT CAST(season AS VARCHAR) AS season, format('gw{{:02d}}', CAST(round AS INTEGER))
      AS gameweek, model, id AS code, name, position, value, round(prediction, 6) AS prediction,
      CAST(row_number() OVER (PARTITION BY season, round, model ORDER BY prediction DESC NULLS LAST, id) AS INTEGER) AS rank
    FROM logged"""
)
def prediction_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prediction_log.read_predictions(spark, _logged_periods(spark, sf_dir))
    return rounded(rows.drop("team"))


@query(
    f"""WITH {_LOGGED}
    SELECT CAST(season AS VARCHAR) AS season, format('gw{{:02d}}', CAST(round AS INTEGER))
      AS gameweek, model, count(*) AS rows, 'suppliers' AS capture, 1 AS models_of_first_write
    FROM logged GROUP BY ALL"""
)
def prediction_log_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = prediction_log.read_manifest(spark, _logged_periods(spark, sf_dir))
    first = entries.where(F.col("made_at") == F.col("first_written_at"))
    per_period = first.groupBy("season", "gameweek").agg(
        F.count("*").cast("int").alias("models_of_first_write")
    )
    return entries.join(per_period, ["season", "gameweek"]).select(
        "season", "gameweek", "model", "rows", "capture", "models_of_first_write"
    )


@query(
    f"""WITH {_LOGGED} SELECT DISTINCT CAST(season AS VARCHAR) AS season,
      format('gw{{:02d}}', CAST(round AS INTEGER)) AS gameweek FROM logged"""
)
def logged_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_log.list_logged(spark, _logged_periods(spark, sf_dir))
