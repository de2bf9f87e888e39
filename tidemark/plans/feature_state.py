"""Features of a coming period from a state that each capture carries forward.

For every season and entity the state holds what the standard features need of all rows so
far: the last few rows, totals to date, and whether the last row had a value. A new capture
repeats the history it already knows; rows up to the last known one are only compared with
it, by count and digest, and rows after it are folded in. An entity whose history was
changed in hindsight, or that is new, is folded from all of its rows. So the state always
equals one made from the newest capture alone, but only new rows are ordered.

Rows are ordered as for the features (period, then tie-breaks, nulls first). An entity that
is not in the capture has no state afterwards. Of an entity's rows no more than the longest
lag is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.operators.features import Feature, Lag, ToDate
from tidemark.operators.ordered import matched
from tidemark.plans import commits
from tidemark.session import written
from tidemark.spec import PanelSpec

COMMIT = "run string, path string"


def _folder(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


class FeatureState:
    """How rows become a state and a state features, for one list of features."""

    def __init__(self, spec: PanelSpec | None = None, wanted: Sequence[Feature] | None = None):
        self.spec = spec or PanelSpec()
        self.features = list(wanted) if wanted is not None else features.standard_features(self.spec)
        self.reach = max([f.rows for f in self.features if isinstance(f, Lag)], default=1)
        self.lags = sorted({f.value for f in self.features if isinstance(f, Lag)})
        self.totals = [f for f in self.features if isinstance(f, ToDate)]

    def _inputs(self, rows: DataFrame) -> DataFrame:
        """Keys, ``_order``, and what the features read of each row."""
        order = F.struct(*[F.col(c).alias(c) for c in self.spec.time_order(rows)])
        lags = [F.expr(v).cast("double").alias(f"_l{i}") for i, v in enumerate(self.lags)]
        totals = [F.expr(f.value).cast("double").alias(f"_t{i}") for i, f in enumerate(self.totals)]
        read = rows.select(*self.spec.entity_keys, order.alias("_order"), F.struct(*lags).alias("_lags"), F.struct(*totals).alias("_totals"))
        digest = F.xxhash64(F.to_json(F.struct("_order", "_lags", "_totals"), {"ignoreNullFields": "false"}))
        return read.withColumn("_digest", digest.cast("decimal(38,0)"))

    def fold(self, rows: DataFrame) -> DataFrame:
        """The state of all given rows."""
        return self._fold(self._inputs(rows))

    def _fold(self, inputs: DataFrame) -> DataFrame:
        keys = self.spec.entity_keys
        # The filter on row_number keeps the last rows of an entity in every task.
        newest_first = Window.partitionBy(*keys).orderBy(F.col("_order").desc())
        last = inputs.withColumn("_nth", F.row_number().over(newest_first)).where(F.col("_nth") <= self.reach)
        tails = last.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("_nth")).alias("at"), "_lags"))).alias("_tail"),
            F.max(F.when(F.col("_nth") == 1, F.struct("_order", "_totals"))).alias("_last"))
        sums = inputs.groupBy(*keys).agg(
            F.count("*").alias("rows"), F.sum("_digest").alias("digest"),
            *[(F.count if f.statistic == "count" else F.sum)(f"_totals._t{i}").alias(f"total{i}") for i, f in enumerate(self.totals)])
        known = F.struct(*[F.col(f"_last._totals._t{i}").isNotNull().alias(f"k{i}") for i in range(len(self.totals))])
        return matched(sums, tails, keys, "inner").select(
            *keys, F.col("_last._order").alias("through"), "rows", "digest",
            F.col("_tail._lags").alias("tail"), known.alias("known"), *[f"total{i}" for i in range(len(self.totals))])

    def advance(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        """The state of ``rows``, a whole history, from an earlier state of most of it."""
        keys = self.spec.entity_keys
        inputs = written(self._inputs(rows), "state-inputs")
        through = state.select(*keys, F.struct("through").alias("_through"), F.col("rows").alias("_rows"), F.col("digest").alias("_seen"))
        placed = matched(inputs, through, keys, "left")
        old = F.col("_through").isNotNull() & (F.col("_order") <= F.col("_through.through"))
        compared = placed.groupBy(*keys).agg(
            F.count_if(old).alias("_old"), F.sum(F.when(old, F.col("_digest"))).alias("_digest_old"),
            F.first("_rows").alias("_rows"), F.first("_seen").alias("_seen"))
        same = F.coalesce((F.col("_old") == F.col("_rows")) & (F.col("_digest_old") == F.col("_seen")), F.lit(False))
        unchanged = written(compared.where(same).select(*keys, F.struct(F.lit(True).alias("yes")).alias("_same")), "state-unchanged")
        fresh = matched(placed, unchanged, keys, "left").where(F.col("_same").isNull() | ~old).select(*inputs.columns)
        added = self._fold(fresh)
        kept = matched(state, unchanged, keys, "left_semi")
        return self._joined(kept, added)

    def _joined(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """One state of two, of which the second begins where the first ends."""
        keys = self.spec.entity_keys
        whole = F.struct(*[F.col(c) for c in before.columns if c not in keys])
        both = before.select(*keys, whole.alias("_a")).unionByName(after.select(*keys, whole.alias("_b")), allowMissingColumns=True)
        # One row of either kind for each entity.
        one = both.groupBy(*keys).agg(F.first("_a", ignorenulls=True).alias("_a"), F.first("_b", ignorenulls=True).alias("_b"))
        newer = lambda c: F.coalesce(F.col(f"_b.{c}"), F.col(f"_a.{c}")).alias(c)

        def total(c: str) -> Column:
            a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
            return F.coalesce(a + b, a, b).alias(c)

        none = F.slice(F.coalesce("_a.tail", "_b.tail"), 1, 0)
        joined = F.concat(F.coalesce("_a.tail", none), F.coalesce("_b.tail", none))
        tail = F.slice(joined, F.greatest(F.size(joined) - self.reach + 1, F.lit(1)), self.reach)
        return one.select(*keys, newer("through"), total("rows"), total("digest"), tail.alias("tail"), newer("known"),
                          *[total(f"total{i}") for i in range(len(self.totals))])

    def attach(self, targets: DataFrame, state: DataFrame) -> DataFrame:
        """``targets`` (one coming row an entity) with every feature; no row is ordered."""
        keys = self.spec.entity_keys
        joined = matched(targets, state.withColumnsRenamed({c: f"_s_{c}" for c in state.columns if c not in keys}), keys, "left")
        columns = []
        for f in self.features:
            if isinstance(f, Lag):
                columns.append(self._lag(f).alias(f.name))
                continue
            i = self.totals.index(f)
            value = F.col(f"_s_total{i}")
            if f.statistic == "count":
                columns.append(F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias(f.name))
            else:
                columns.append(F.when(F.col(f"_s_known.k{i}"), value).alias(f.name))
        return joined.select(*targets.columns, *columns).withColumn("points_per90_todate", features.per_full_exposure(self.spec))

    def _lag(self, f: Lag) -> Column:
        field = f"_l{self.lags.index(f.value)}"
        tail = F.col("_s_tail")
        recent = F.slice(tail, F.greatest(F.size(tail) - f.rows + 1, F.lit(1)), f.rows)
        values = F.filter(F.transform(recent, lambda x: x[field]), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(values) > 0, total / F.size(values) if f.statistic == "mean" else total)


def load(spark: SparkSession, root: str) -> tuple[str, DataFrame] | None:
    """The run and the table of the newest stored state; None before the first."""
    log = _folder(root, "commits")
    number = commits.newest(spark, log)
    if not number:
        return None
    entry = commits.entries(spark, log, COMMIT).where(F.col("version") == number).first()
    return entry.run, spark.read.parquet(f"{root.rstrip('/')}/{entry.path}")


def store(spark: SparkSession, root: str, run: str, state: DataFrame) -> DataFrame:
    """Keep a state as the newest; readers see it once it is whole."""
    number = commits.newest(spark, _folder(root, "commits"))
    path = f"states/{number + 1:010d}-{commits.unique()}"
    state.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{path}")
    commits.commit(spark, _folder(root, "commits"), [{"run": run, "path": path}], lambda seen: None)
    return spark.read.parquet(f"{root.rstrip('/')}/{path}")
