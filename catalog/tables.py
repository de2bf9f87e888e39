"""The given tables, and the supplier-by-month panel the panel queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import clean, features
from tidemark.session import tune, written

MONTHS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_bound(spark: SparkSession, sf_dir: str) -> int:
    """Most rows one month can have: one per supplier. Read from file footers."""
    return table(spark, sf_dir, "supplier").count()


def labelled_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, position (region), value (balance; an overdrawn one has no price)."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_suppkey").alias("code"),
        F.col("s_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("position"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("value"),
    )


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and month of shipping; summed before it is shuffled."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(
        F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("round"),
        F.col("l_suppkey").alias("code"),
    ).agg(
        F.sum("l_quantity").alias("total_points"),
        (F.count("*") * F.lit(10.0)).alias("minutes"),
        F.countDistinct("l_partkey").cast("double").alias("selected"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("transfers_balance"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel, with last year's outcome of the same month as its forecast.

    The cells are joined to suppliers and then ordered inside one supplier, both
    on ``code``, so a large run shuffles the cells once for all of it and the
    (season, code) windows that follow need no further exchange.
    """
    cells = monthly_cells(spark, sf_dir).join(
        labelled_suppliers(spark, sf_dir), "code", "left"
    )
    # At most 12 months times the years on sale per supplier.
    same_month = Window.partitionBy("code").orderBy("round", "season")
    last = F.struct("round", "season", "total_points")
    return (
        cells.withColumn("_last", F.lag(last).over(same_month))
        .withColumn(
            "xP",
            F.when(
                (F.col("_last.round") == F.col("round"))
                & (F.col("_last.season") == F.col("season") - 1),
                F.col("_last.total_points"),
            ),
        )
        .select(
            "season", "round", "code", "name", "position", "total_points", "minutes", "value",
            "selected", "transfers_balance", "xP",
        )
    )


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the standard features; a supplier's year has 12 rows at most."""
    return features.build(panel(spark, sf_dir), group_rows=MONTHS)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as a written table, for queries that read them several times."""
    return written(feature_frame(spark, sf_dir), "features")


def to_date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the one feature shrinkage needs, as a written table."""
    rows = clean.prepare(panel(spark, sf_dir)).drop("selected", "transfers_balance", "xP")
    total = features.expanding("total_points")
    return written(features.add_features(rows, [total], group_rows=MONTHS), "to-date")


# The same panel and features in SQL, as common table expressions.
PANEL_SQL = """
cells AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS round,
         l_suppkey AS code, sum(l_quantity) AS total_points,
         CAST(count(*) AS DOUBLE) * 10 AS minutes,
         CAST(count(DISTINCT l_partkey) AS DOUBLE) AS selected,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS transfers_balance
  FROM lineitem GROUP BY 1, 2, 3),
panel AS (
  SELECT c.season, c.round, c.code, s.s_name AS name, CAST(n.n_regionkey AS VARCHAR) AS position,
         c.total_points, c.minutes,
         CASE WHEN s.s_acctbal >= 0 THEN s.s_acctbal END AS value,
         c.selected, c.transfers_balance, p.total_points AS "xP"
  FROM cells c
  LEFT JOIN supplier s ON s.s_suppkey = c.code
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN cells p ON p.season = c.season - 1 AND p.round = c.round AND p.code = c.code)
"""

FEATURE_SQL = (
    PANEL_SQL
    + """,
lags AS (
  SELECT season, CAST(round AS DOUBLE) AS round, code, name, position, total_points, minutes,
         value, selected, transfers_balance, "xP",
         avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS total_points_mean5,
         avg(total_points) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
           AS total_points_mean10,
         avg(minutes) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS minutes_mean3,
         avg(minutes) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS minutes_mean5,
         CASE WHEN lag(total_points) OVER w IS NOT NULL THEN sum(total_points)
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END
           AS total_points_todate_sum,
         CASE WHEN lag(minutes) OVER w IS NOT NULL THEN sum(minutes)
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS minutes_todate_sum,
         avg(CASE WHEN minutes >= 60 THEN 1.0 ELSE 0.0 END)
           OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS started_rate5,
         CASE WHEN lag(minutes) OVER w IS NOT NULL THEN
           sum(CASE WHEN minutes > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS appearances_todate
  FROM panel WINDOW w AS (PARTITION BY season, code ORDER BY round)),
features AS (
  SELECT *, CASE WHEN minutes_todate_sum > 0
                 THEN total_points_todate_sum / minutes_todate_sum * 90 END AS points_per90_todate
  FROM lags)
"""
)
