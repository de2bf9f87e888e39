"""Panel, features, ranks, rules, shrinkage and scores on the supplier panel."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import ORACLES, query, rounded
from catalog.tables import (
    FEATURE_SQL,
    MONTHS,
    PANEL_SQL,
    feature_frame,
    feature_table,
    panel,
    supplier_bound,
    to_date_table,
)
from tidemark.operators import baselines, features, metrics, ordered, ranks, shrinkage
from tidemark.plans import backtest, predictors
from tidemark.spec import PanelSpec

SPEC = PanelSpec()
KEYS = ["season", "round", "code"]


# --- the panel ---------------------------------------------------------------


@query(f"WITH {PANEL_SQL} SELECT * FROM panel")
def demo_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir)


# --- lagged features ---------------------------------------------------------


def _lagged(spark: SparkSession, sf_dir: str, *wanted) -> DataFrame:
    rows = panel(spark, sf_dir).select(*KEYS, "total_points", "minutes", "xP")
    out = features.add_features(rows, wanted, SPEC, group_rows=MONTHS)
    return rounded(out.select(*KEYS, *[f.name for f in wanted]))


@query(
    f"""WITH {PANEL_SQL} SELECT season, round, code,
      round(avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6)
        AS total_points_mean5,
      round(avg(total_points) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6)
        AS total_points_mean10
    FROM panel WINDOW w AS (PARTITION BY season, code ORDER BY round)"""
)
def lagged_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lagged(
        spark, sf_dir, features.lagged("total_points", 5), features.lagged("total_points", 10)
    )


@query(
    f"""WITH {PANEL_SQL} SELECT season, round, code,
      round(sum(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6)
        AS total_points_sum3,
      round(sum(minutes) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS minutes_sum5
    FROM panel WINDOW w AS (PARTITION BY season, code ORDER BY round)"""
)
def lagged_rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lagged(
        spark,
        sf_dir,
        features.lagged("total_points", 3, "sum"),
        features.lagged("minutes", 5, "sum"),
    )


_TO_DATE = f"""WITH {PANEL_SQL} SELECT season, round, code,
      CASE WHEN lag(total_points) OVER w IS NOT NULL THEN round(sum(total_points)
        OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) END
        AS total_points_todate_sum,
      count(total_points) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS total_points_todate_count,
      CASE WHEN lag("xP") OVER w IS NOT NULL THEN round(sum("xP")
        OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) END AS "xP_todate_sum",
      count("xP") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS "xP_todate_count"
    FROM panel WINDOW w AS (PARTITION BY season, code ORDER BY round)"""


@query(_TO_DATE)
def to_date_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums follow the rule for a null just before; the forecast column has nulls."""
    return _lagged(
        spark,
        sf_dir,
        features.expanding("total_points"),
        features.expanding("total_points", "count"),
        features.expanding("xP"),
        features.expanding("xP", "count"),
    )


@query(
    f"""WITH {FEATURE_SQL} SELECT season, CAST(round AS INTEGER) AS round, code,
      round(started_rate5, 6) AS started_rate5, round(appearances_todate, 6)
      AS appearances_todate FROM features"""
)
def recent_starts_and_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [f for f in features.standard_features() if f.name.startswith(("started", "app"))]
    return _lagged(spark, sf_dir, *wanted)


_FEATURE_COLUMNS = [
    "total_points_mean5", "total_points_mean10", "minutes_mean3", "minutes_mean5",
    "total_points_todate_sum", "minutes_todate_sum", "started_rate5", "appearances_todate",
    "points_per90_todate",
]
_FEATURE_SET = "WITH {} SELECT season, round, code, {} FROM features".format(
    FEATURE_SQL, ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURE_COLUMNS)
)


@query(_FEATURE_SET)
def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_frame(spark, sf_dir).select(*KEYS, *_FEATURE_COLUMNS))


@query(_FEATURE_SET)
def feature_set_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for seasons too long for one task, chosen here for short ones."""
    built = features.build(panel(spark, sf_dir), group_rows=MONTHS, plan=ordered.SPLIT)
    return rounded(built.select(*KEYS, *_FEATURE_COLUMNS))


@query(
    f"""WITH {FEATURE_SQL} SELECT season, round, code,
      round(points_per90_todate, 6) AS points_per90_todate FROM features"""
)
def rate_per_full_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(spark, sf_dir)
    return rounded(frame.select(*KEYS, "points_per90_todate"))


# --- ranks -------------------------------------------------------------------

_RANK_SQL = f"""WITH {PANEL_SQL}, placed AS (
      SELECT season, round, code, value,
             rank() OVER (PARTITION BY season, round ORDER BY value NULLS LAST) AS first_place,
             count(*) OVER (PARTITION BY season, round, value) AS peers,
             rank() OVER (PARTITION BY season, round ORDER BY transfers_balance) AS flow_place,
             count(*) OVER (PARTITION BY season, round, transfers_balance) AS flow_peers,
             count(*) OVER (PARTITION BY season, round) AS period_rows
      FROM panel)
    SELECT season, round, code,
           CASE WHEN value IS NOT NULL THEN round(first_place + (peers - 1) / 2.0, 6) END
             AS value_rank,
           round(flow_place + (flow_peers - 1) / 2.0, 6) AS flow_rank
    FROM placed"""


def _two_ranks(spark: SparkSession, sf_dir: str, plan: str | None = None) -> DataFrame:
    lean = panel(spark, sf_dir).select(*KEYS, "value", "transfers_balance")
    keys = SPEC.period_keys
    given = {"group_rows": supplier_bound(spark, sf_dir), "plan": plan}
    by_value = ranks.average_rank(lean, keys, "value", "value_rank", **given)
    both = ranks.average_rank(by_value, keys, "transfers_balance", "flow_rank", **given)
    return rounded(both.select(*KEYS, "value_rank", "flow_rank"))


@query(_RANK_SQL)
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_ranks(spark, sf_dir)


@query(_RANK_SQL)
def average_rank_by_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for periods too large for one task, chosen here for small ones."""
    return _two_ranks(spark, sf_dir, ordered.SPLIT)


_BUCKET_CTE = """, placed AS (
      SELECT *, rank() OVER (PARTITION BY season, round ORDER BY value NULLS LAST) AS first_place,
             count(*) OVER (PARTITION BY season, round, value) AS peers,
             count(*) OVER (PARTITION BY season, round) AS period_rows
      FROM {source}),
    bucketed AS (
      SELECT *, CASE WHEN value IS NOT NULL THEN CAST(least(greatest(
               ceil((first_place + (peers - 1) / 2.0) / period_rows * 10), 1), 10) AS DOUBLE) END
               AS price_bucket
      FROM placed)"""


@query(
    f"""WITH {PANEL_SQL}{_BUCKET_CTE.format(source='panel')}
    SELECT season, round, code, price_bucket FROM bucketed"""
)
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_bound(spark, sf_dir)
    lean = panel(spark, sf_dir).select(*KEYS, "value")
    return ranks.price_bucket(lean, group_rows=rows).select(*KEYS, "price_bucket")


@query(
    f"""WITH {PANEL_SQL} SELECT season, round, code,
      count(*) OVER (PARTITION BY season, round) AS period_rows FROM panel"""
)
def partition_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_bound(spark, sf_dir)
    lean = panel(spark, sf_dir).select(*KEYS)
    return ranks.group_length(lean, SPEC.period_keys, "period_rows", group_rows=rows)


_OUTPUT_RANK = f"""WITH {FEATURE_SQL} SELECT season, round, code,
      CAST(row_number() OVER (PARTITION BY season, round
           ORDER BY coalesce(total_points_mean5, 0) DESC, code) AS INTEGER) AS rank
    FROM features"""


def _output_rank(spark: SparkSession, sf_dir: str, plan: str | None = None) -> DataFrame:
    scored = baselines.predict(feature_frame(spark, sf_dir), "rolling_mean5")
    lean = scored.select(*KEYS, "prediction")
    rows = supplier_bound(spark, sf_dir)
    ranked = ranks.output_rank(lean, SPEC.period_keys, group_rows=rows, plan=plan)
    return ranked.select(*KEYS, "rank")


@query(_OUTPUT_RANK)
def output_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _output_rank(spark, sf_dir)


@query(_OUTPUT_RANK)
def output_rank_by_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _output_rank(spark, sf_dir, ordered.SPLIT)


# --- rules -------------------------------------------------------------------

CROWD_SQL = """, crowd AS (
      SELECT *, rank() OVER (PARTITION BY season, round ORDER BY selected)
               + (count(*) OVER (PARTITION BY season, round, selected) - 1) / 2.0
               + 0.5 * (rank() OVER (PARTITION BY season, round ORDER BY transfers_balance)
               + (count(*) OVER (PARTITION BY season, round, transfers_balance) - 1) / 2.0)
               AS crowd_score
      FROM features)"""

RULE_SQL = {
    "rate_x_exposure": "coalesce(points_per90_todate * minutes_mean5 / 90, 0)",
    "rolling_mean5": "coalesce(total_points_mean5, 0)",
    "published_forecast": 'coalesce("xP", 0)',
    "crowd": "crowd_score",
}


def _register_rule(rule: str, expression: str) -> None:
    sql = f"""WITH {FEATURE_SQL}{CROWD_SQL} SELECT season, round, code,
      round(CAST({expression} AS DOUBLE), 6) AS prediction FROM crowd"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = feature_frame(spark, sf_dir)
        predicted = baselines.predict(frame, rule, group_rows=supplier_bound(spark, sf_dir))
        return rounded(predicted.select(*KEYS, "prediction"))

    query(sql, name=f"rule_{rule}")(run)


for _rule, _expression in RULE_SQL.items():
    _register_rule(_rule, _expression)

_LONG = " UNION ALL ".join(
    f"""SELECT '{rule}' AS baseline, {str(rule != 'crowd').lower()} AS on_scale, season, round,
      code, name, position, CAST({expression} AS DOUBLE) AS prediction, total_points AS actual,
      minutes FROM crowd"""
    for rule, expression in RULE_SQL.items()
)
RESULT_SQL = f"{FEATURE_SQL}{CROWD_SQL}, scored AS ({_LONG}), results AS (SELECT * FROM scored WHERE round >= 6)"


@query(
    f"""WITH {FEATURE_SQL}{CROWD_SQL}, scored AS ({_LONG})
    SELECT baseline, season, round, code, round(prediction, 6) AS prediction FROM scored"""
)
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = baselines.predict_all(
        feature_frame(spark, sf_dir), group_rows=supplier_bound(spark, sf_dir)
    )
    return rounded(scored.select("baseline", *KEYS, "prediction"))


# --- walk-forward results and scores ----------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.baseline_results(
        feature_frame(spark, sf_dir), group_rows=supplier_bound(spark, sf_dir), keep=True
    )


@query(
    f"""WITH {FEATURE_SQL} SELECT season, round, code, name, position,
      round(coalesce(total_points_mean5, 0), 6) AS prediction,
      round(total_points, 6) AS actual, round(minutes, 6) AS minutes
    FROM features WHERE round >= 6"""
)
def walk_forward_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(spark, sf_dir)
    return rounded(backtest.walk_forward(frame, "rolling_mean5", check=False))


def correlation_sql(results: str = "results", by: str = "baseline") -> str:
    """Ranks and corr() as SQL has them, over all rows and over played rows."""

    def part(label: str, where: str) -> str:
        return f"""{label}_ranked AS (
          SELECT {by}, season, round, position,
            rank() OVER (g ORDER BY prediction)
              + (count(*) OVER (PARTITION BY {by}, season, round, position, prediction) - 1) / 2.0
              AS p,
            rank() OVER (g ORDER BY actual)
              + (count(*) OVER (PARTITION BY {by}, season, round, position, actual) - 1) / 2.0
              AS a
          FROM {results}
          WHERE prediction IS NOT NULL AND actual IS NOT NULL AND {where}
          WINDOW g AS (PARTITION BY {by}, season, round, position)),
        {label}_groups AS (
          SELECT {by}, season, round, position, count(*) AS n, corr(p, a) AS rho
          FROM {label}_ranked GROUP BY ALL),
        {label} AS (
          SELECT {by}, avg(rho) FILTER (WHERE n >= 5 AND NOT isnan(rho)) AS rank_corr
          FROM {label}_groups GROUP BY {by})"""

    return part("every", "true") + ", " + part("played", "minutes > 0")


_CORRELATION = f"""WITH {RESULT_SQL}, {correlation_sql()}
    SELECT every.baseline, round(every.rank_corr, 6) + 0.0 AS rank_corr,
           round(played.rank_corr, 6) + 0.0 AS rank_corr_played
    FROM every LEFT JOIN played USING (baseline)"""


def _correlation(spark: SparkSession, sf_dir: str, plan: str | None = None) -> DataFrame:
    rows = supplier_bound(spark, sf_dir)
    results = _results(spark, sf_dir)
    return rounded(
        metrics.rank_correlation(results, SPEC, ["baseline"], group_rows=rows, plan=plan)
    )


@query(_CORRELATION)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlation(spark, sf_dir)


@query(_CORRELATION)
def rank_correlation_by_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlation(spark, sf_dir, ordered.SPLIT)


_OVERLAP = """tops AS (
      SELECT baseline, season, round, code,
        row_number() OVER (PARTITION BY baseline, season, round
                           ORDER BY prediction DESC, code) AS p,
        row_number() OVER (PARTITION BY baseline, season, round ORDER BY actual DESC, code) AS a,
        count(*) OVER (PARTITION BY baseline, season, round) AS n
      FROM results WHERE prediction IS NOT NULL AND actual IS NOT NULL),
    shares AS (
      SELECT baseline, season, round, max(n) AS n,
             count(DISTINCT code) FILTER (WHERE p <= 20 AND a <= 20) / 20.0 AS share
      FROM tops GROUP BY ALL),
    overlap AS (
      SELECT baseline, avg(share) FILTER (WHERE n >= 40) AS top20_overlap
      FROM shares GROUP BY baseline)"""


@query(
    f"""WITH {RESULT_SQL}, {_OVERLAP}
    SELECT baseline, round(top20_overlap, 6) AS top20_overlap FROM overlap"""
)
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.top_overlap(_results(spark, sf_dir), SPEC, ["baseline"]))


_ERRORS = """errors AS (
      SELECT baseline, bool_and(on_scale) AS on_scale,
             count(DISTINCT (season, round)) AS periods, count(*) AS rows,
             avg(abs(prediction - actual)) AS mae,
             avg(abs(prediction - actual)) FILTER (WHERE minutes > 0) AS mae_played
      FROM results GROUP BY baseline)"""


@query(
    f"""WITH {RESULT_SQL} SELECT baseline, season, round, count(*) AS rows,
      round(avg(abs(prediction - actual)), 6) AS mae,
      round(avg(abs(prediction - actual)) FILTER (WHERE minutes > 0), 6) AS mae_played
    FROM results GROUP BY ALL"""
)
def absolute_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.period_errors(_results(spark, sf_dir), SPEC, ["baseline"])
    return rounded(
        each.select(
            "baseline", "season", "round", "rows",
            F.try_divide("error", "scored").alias("mae"),
            F.try_divide("error_played", "scored_played").alias("mae_played"),
        )
    )


@query(
    f"""WITH {RESULT_SQL} SELECT baseline, count(DISTINCT (season, round)) AS periods,
      count(*) AS rows FROM results GROUP BY baseline"""
)
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.period_errors(_results(spark, sf_dir), SPEC, ["baseline"])
    return each.groupBy("baseline").agg(
        F.count("*").alias("periods"), F.sum("rows").alias("rows")
    )


_SCORES = f"""WITH {RESULT_SQL}, {correlation_sql()}, {_OVERLAP}, {_ERRORS}
    SELECT errors.baseline, periods, rows, round(every.rank_corr, 6) + 0.0 AS rank_corr,
           round(played.rank_corr, 6) + 0.0 AS rank_corr_played,
           round(top20_overlap, 6) AS top20_overlap,
           CASE WHEN on_scale THEN round(mae, 6) END AS mae,
           CASE WHEN on_scale THEN round(mae_played, 6) END AS mae_played
    FROM errors LEFT JOIN every USING (baseline) LEFT JOIN played USING (baseline)
    LEFT JOIN overlap USING (baseline)"""


@query(_SCORES)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: four rules, walk-forward, every metric, one job."""
    frame = feature_frame(spark, sf_dir)
    board = backtest.compare_baselines(frame, group_rows=supplier_bound(spark, sf_dir))
    return rounded(board)


@query(_SCORES + " WHERE errors.baseline = 'rolling_mean5'")
def score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = backtest.walk_forward(feature_table(spark, sf_dir), "rolling_mean5", check=False)
    card = metrics.score(results, SPEC, group_rows=supplier_bound(spark, sf_dir))
    return rounded(card.withColumn("baseline", F.lit("rolling_mean5")))


# --- shrinkage ---------------------------------------------------------------

_USABLE = """, usable_rows AS (
      SELECT * FROM features WHERE total_points IS NOT NULL AND value IS NOT NULL
        AND position IS NOT NULL {extra})""" + _BUCKET_CTE.format(source="usable_rows")


@query(
    f"""WITH {FEATURE_SQL}{_USABLE.format(extra='')}
    SELECT position, price_bucket, round(avg(total_points), 6) AS prior_mean
    FROM bucketed GROUP BY ALL"""
)
def prior_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_bound(spark, sf_dir)
    prior = shrinkage.fit(panel(spark, sf_dir), group_rows=rows)
    return rounded(prior.table)


_STRENGTH = """, entity_moments AS (
      SELECT season, code, avg(total_points) AS m, var_samp(total_points) AS v, count(*) AS n
      FROM bucketed GROUP BY ALL HAVING count(*) >= 5),
    pooled AS (
      SELECT avg(v) AS within, var_samp(m) AS spread, avg(n) AS mean_n, count(*) AS entities
      FROM entity_moments WHERE v IS NOT NULL),
    strength AS (
      SELECT CASE WHEN entities > 5 AND spread - within / mean_n > 1e-6 AND within > 0
                  THEN within / (spread - within / mean_n) ELSE 10.0 END AS k
      FROM pooled),
    overall AS (SELECT avg(total_points) AS grand_mean, count(*) AS n FROM bucketed)"""


@query(
    f"""WITH {FEATURE_SQL}{_USABLE.format(extra='')}{_STRENGTH}
    SELECT round(CASE WHEN n < 200 THEN 10.0 ELSE k END, 4) AS k,
           round(grand_mean, 6) AS grand_mean
    FROM strength, overall"""
)
def shrinkage_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_bound(spark, sf_dir)
    scalars = shrinkage.fit(panel(spark, sf_dir), group_rows=rows).scalars
    return scalars.select(
        F.round("k", 4).alias("k"), F.round("grand_mean", 6).alias("grand_mean")
    )


_FIXED_FROM = 1998


@query(
    f"""WITH {FEATURE_SQL}{_USABLE.format(extra='AND season < 1998')}{_STRENGTH},
    prior AS (SELECT position, price_bucket, avg(total_points) AS prior_mean
              FROM bucketed GROUP BY ALL),
    target AS (
      SELECT *, rank() OVER (PARTITION BY season, round ORDER BY value NULLS LAST) AS fp,
             count(*) OVER (PARTITION BY season, round, value) AS pe,
             count(*) OVER (PARTITION BY season, round) AS pr
      FROM features WHERE season >= 1998 AND round >= 6),
    placed_target AS (
      SELECT *, CASE WHEN value IS NOT NULL THEN
               CAST(least(greatest(ceil((fp + (pe - 1) / 2.0) / pr * 10), 1), 10) AS DOUBLE) END
               AS price_bucket FROM target)
    SELECT t.season, t.round, t.code, t.name, t.position,
           round((coalesce(t.total_points_todate_sum, 0)
             + (CASE WHEN o.n < 200 THEN 10.0 ELSE s.k END)
               * coalesce(CASE WHEN o.n >= 200 THEN p.prior_mean END, o.grand_mean))
             / (greatest(t.round - 1, 0) + (CASE WHEN o.n < 200 THEN 10.0 ELSE s.k END)), 6)
             AS prediction,
           round(t.total_points, 6) AS actual, round(t.minutes, 6) AS minutes
    FROM placed_target t CROSS JOIN strength s CROSS JOIN overall o
    LEFT JOIN prior p ON p.position = t.position AND p.price_bucket = t.price_bucket"""
)
def shrunk_fixed_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later seasons predicted from a prior fitted once on the earlier ones."""
    frame = to_date_table(spark, sf_dir)
    results = backtest.walk_forward_shrinkage(
        frame.where(F.col("season") >= _FIXED_FROM),
        past_seasons=frame.where(F.col("season") < _FIXED_FROM),
        group_rows=supplier_bound(spark, sf_dir),
    )
    return rounded(results)


@query(
    f"""WITH {FEATURE_SQL}{_USABLE.format(extra='')},
    cutoffs AS (SELECT DISTINCT season, round AS cutoff FROM features WHERE round >= 6),
    history AS (
      SELECT c.cutoff, b.* FROM bucketed b
      JOIN cutoffs c ON c.season = b.season AND b.round < c.cutoff),
    prior AS (
      SELECT season, cutoff, position, price_bucket, avg(total_points) AS prior_mean
      FROM history GROUP BY ALL),
    overall AS (
      SELECT season, cutoff, avg(total_points) AS grand_mean, count(*) AS n
      FROM history GROUP BY ALL),
    entity_moments AS (
      SELECT season, cutoff, code, avg(total_points) AS m, var_samp(total_points) AS v,
             count(*) AS n
      FROM history GROUP BY ALL HAVING count(*) >= 5),
    pooled AS (
      SELECT season, cutoff, avg(v) AS within, var_samp(m) AS spread, avg(n) AS mean_n,
             count(*) AS entities
      FROM entity_moments WHERE v IS NOT NULL GROUP BY ALL),
    fitted AS (
      SELECT o.season, o.cutoff, o.grand_mean, o.n,
             CASE WHEN o.n >= 200 AND p.entities > 5 AND p.spread - p.within / p.mean_n > 1e-6
                       AND p.within > 0
                  THEN p.within / (p.spread - p.within / p.mean_n) ELSE 10.0 END AS k
      FROM overall o LEFT JOIN pooled p ON p.season = o.season AND p.cutoff = o.cutoff),
    target AS (
      SELECT *, rank() OVER (PARTITION BY season, round ORDER BY value NULLS LAST) AS fp,
             count(*) OVER (PARTITION BY season, round, value) AS pe,
             count(*) OVER (PARTITION BY season, round) AS pr
      FROM features WHERE round >= 6),
    placed_target AS (
      SELECT *, CASE WHEN value IS NOT NULL THEN
               CAST(least(greatest(ceil((fp + (pe - 1) / 2.0) / pr * 10), 1), 10) AS DOUBLE) END
               AS price_bucket FROM target)
    SELECT t.season, t.round, t.code, t.name, t.position,
           round((coalesce(t.total_points_todate_sum, 0) + f.k
             * coalesce(CASE WHEN f.n >= 200 THEN p.prior_mean END, f.grand_mean))
             / (greatest(t.round - 1, 0) + f.k), 6) AS prediction,
           round(t.total_points, 6) AS actual, round(t.minutes, 6) AS minutes
    FROM placed_target t
    LEFT JOIN fitted f ON f.season = t.season AND f.cutoff = t.round
    LEFT JOIN prior p ON p.season = t.season AND p.cutoff = t.round
      AND p.position = t.position AND p.price_bucket = t.price_bucket"""
)
def walk_forward_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior refitted before every period, for all periods in one job."""
    results = backtest.walk_forward_shrinkage(
        to_date_table(spark, sf_dir), group_rows=supplier_bound(spark, sf_dir)
    )
    return rounded(results)


def _group_history_mean(history: DataFrame, target: DataFrame) -> DataFrame:
    """A user's own predictor: mean outcome of the group so far this season."""
    means = history.groupBy("season", "cutoff", "position").agg(
        F.avg("total_points").alias("prediction")
    )
    return target.join(means, ["season", "cutoff", "position"], "left")


@query(
    f"""WITH {FEATURE_SQL}, means AS (
      SELECT c.season, c.cutoff, f.position, avg(f.total_points) AS prediction
      FROM (SELECT DISTINCT season, round AS cutoff FROM features WHERE round >= 6) c
      JOIN features f ON f.season = c.season AND f.round < c.cutoff GROUP BY ALL)
    SELECT f.season, f.round, f.code, f.name, f.position, round(m.prediction, 6) AS prediction,
           round(f.total_points, 6) AS actual, round(f.minutes, 6) AS minutes
    FROM features f LEFT JOIN means m ON m.season = f.season AND m.cutoff = f.round
      AND m.position = f.position
    WHERE f.round >= 6"""
)
def custom_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(spark, sf_dir)
    return rounded(backtest.walk_forward(frame, _group_history_mean, check=False))


def _group_mean() -> predictors.AggregatePredictor:
    return predictors.AggregatePredictor(
        keys=["position"],
        partial={"points": F.sum("total_points"), "known": F.count("total_points")},
        merge={"points": F.sum("points"), "known": F.sum("known")},
        prediction=F.col("points") / F.col("known"),
    )


@query(ORACLES["custom_predictor"])
def aggregate_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``custom_predictor`` from aggregates of dyadic blocks of periods."""
    return rounded(backtest.walk_forward(feature_table(spark, sf_dir), _group_mean(), check=False))


MEDIAN_BIN = 8


class GroupMedian(predictors.MergeablePredictor):
    """Median outcome of the group so far, to the middle of a bin of ``MEDIAN_BIN`` points.

    The state is a histogram for each group, as long as the range of the outcome is wide.
    """

    history = ("position", "total_points")
    target = ("position",)

    def zero(self):
        return Counter()

    def add(self, state, rows):
        known = rows.dropna(subset=["total_points"])
        bins = (known["total_points"].astype(float) // MEDIAN_BIN).astype(int)
        state.update(zip(known["position"].map(lambda p: p if isinstance(p, str) else None), bins))
        return state

    def merge(self, left, right):
        left.update(right)
        return left

    def predict(self, state, target):
        bins = defaultdict(list)
        for (position, at), n in sorted(state.items(), key=lambda x: x[0][1]):
            bins[position].append((at, n))
        middle = {}
        for position, counts in bins.items():
            seen, half = 0, (sum(n for _, n in counts) + 1) // 2
            for at, n in counts:
                seen += n
                if seen >= half:
                    middle[position] = at * MEDIAN_BIN + MEDIAN_BIN / 2
                    break
        return [middle.get(p if isinstance(p, str) else None) for p in target["position"]]


@query(
    f"""WITH {FEATURE_SQL}, cutoffs AS (SELECT DISTINCT season, round AS cutoff FROM features WHERE round >= 6),
    bins AS (
      SELECT c.season, c.cutoff, f.position, CAST(floor(f.total_points / {MEDIAN_BIN}) AS BIGINT) AS b, count(*) AS n
      FROM cutoffs c JOIN features f ON f.season = c.season AND f.round < c.cutoff
      WHERE f.total_points IS NOT NULL GROUP BY ALL),
    running AS (
      SELECT *, sum(n) OVER (PARTITION BY season, cutoff, position ORDER BY b) AS seen,
             sum(n) OVER (PARTITION BY season, cutoff, position) AS total FROM bins),
    medians AS (
      SELECT season, cutoff, position, min(b) * {MEDIAN_BIN} + {MEDIAN_BIN / 2} AS prediction
      FROM running WHERE seen >= (total + 1) // 2 GROUP BY ALL)
    SELECT f.season, f.round, f.code, f.name, f.position, CAST(m.prediction AS DOUBLE) AS prediction,
           round(f.total_points, 6) AS actual, round(f.minutes, 6) AS minutes
    FROM features f LEFT JOIN medians m ON m.season = f.season AND m.cutoff = f.round
      AND m.position IS NOT DISTINCT FROM f.position
    WHERE f.round >= 6"""
)
def mergeable_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor in Python: histograms from every task, merged over blocks of periods."""
    return rounded(backtest.walk_forward(feature_table(spark, sf_dir), GroupMedian(), check=False))
