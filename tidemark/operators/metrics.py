"""Scores of walk-forward results: rank agreement, top-k overlap, error.

A results table has season, period, entity, group, ``prediction``, ``actual`` and
exposure. ``by`` lists extra key columns (such as the rule's name), so that any
number of models is scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import ordered, ranks
from tidemark.session import counted, written
from tidemark.spec import PanelSpec


def _scored(results: DataFrame) -> DataFrame:
    return results.dropna(subset=["prediction", "actual"])


def _spearman(x: Column, y: Column, weight: Column, keep: Column) -> Column:
    """Correlation of ranks already centred on their exact mean.

    Average ranks of n rows always have mean (n + 1) / 2. Centring on that makes
    every term a multiple of a quarter, so a group without spread gives exactly
    zero and hence null, with no rounding noise to test for.
    """
    def total(term: Column) -> Column:
        return F.sum(F.when(keep, term * weight))

    return F.try_divide(total(x * y), F.sqrt(total(x * x) * total(y * y)))


def _centred(rank: str, length: str) -> Column:
    return F.col(rank) - (F.col(length) + 1) / F.lit(2.0)


def _by_window(rows: DataFrame, group: list[str]) -> DataFrame:
    """Both row sets, all and played, from one exchange on the group."""
    sets = {"": group, "_played": [*group, "_played"]}
    ranked = rows.select(
        *group,
        "_played",
        *[
            ranks.average_rank_column(F.col(side), keys).alias(f"_{side}{label}")
            for label, keys in sets.items()
            for side in ("prediction", "actual")
        ],
        *[
            F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(f"_n{label}")
            for label, keys in sets.items()
        ],
    )
    keep = {"": F.lit(True), "_played": F.col("_played")}
    return ranked.groupBy(*group).agg(
        *[
            _spearman(
                _centred(f"_prediction{label}", f"_n{label}"),
                _centred(f"_actual{label}", f"_n{label}"),
                F.lit(1),
                keep[label],
            ).alias(f"rho{label}")
            for label in sets
        ],
        F.count("*").alias("n"),
        F.count_if("_played").alias("n_played"),
    )


def _value_ranks(pairs: DataFrame, group: list[str], group_rows: int) -> DataFrame:
    """The average rank of each value of either side, among all and among played rows.

    Both sides are values of one column and both row sets totals of one order, so one
    exchange by group, side and value gives all four ranks.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), F.col(c).alias("_value"))
                      for i, c in enumerate(("prediction", "actual"))])
    each = pairs.select(*group, "_n", "_n_played", F.inline(sides))
    keys = [*group, "_side"]
    shape = each.groupBy(*keys, "_value").agg(
        F.sum("_n").alias("_m"), F.sum("_n_played").alias("_m_played"), F.count("*").alias("_rows"))
    placed = ordered.with_totals_before(
        shape, keys, [F.col("_value")], {"_b": F.col("_m"), "_b_played": F.col("_m_played")}, group_rows)

    def rank(before: str, ties: str) -> Column:
        return F.coalesce(F.col(before), F.lit(0)) + (F.col(ties) + 1) / F.lit(2.0)

    both = F.struct(rank("_b", "_m").alias("all"), rank("_b_played", "_m_played").alias("played"))
    return written(placed.select(*keys, "_value", "_rows", both.alias("_rank")), "value-ranks")


def _by_histogram(rows: DataFrame, group: list[str], group_rows: int) -> DataFrame:
    """Equal (prediction, actual) pairs are counted before anything is ranked."""
    pairs = written(rows.groupBy(*group, "prediction", "actual").agg(
        F.count("*").alias("_n"), F.count_if("_played").alias("_n_played")), "pairs")
    ranked = _value_ranks(pairs, group, group_rows)
    out = pairs
    for i, side in enumerate(("prediction", "actual")):
        of_side = ranked.where(F.col("_side") == i).select(*group, F.col("_value").alias(side), "_rows", "_rank")
        out = ordered.join_per_value(out, of_side, group, side, "_rows", "_rank", stored=True).withColumnRenamed("_rank", f"_{side}")
    sizes = pairs.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum("_n_played").alias("n_played"))
    joined = ordered.matched(out, counted(sizes, "group-sizes"), group, "inner")
    return joined.groupBy(*group).agg(
        _spearman(_centred("_prediction.all", "n"), _centred("_actual.all", "n"), F.col("_n"), F.lit(True)).alias("rho"),
        _spearman(_centred("_prediction.played", "n_played"), _centred("_actual.played", "n_played"),
                  F.col("_n_played"), F.col("_n_played") > 0).alias("rho_played"),
        F.max("n").alias("n"),
        F.max("n_played").alias("n_played"),
    )


def group_correlations(
    results: DataFrame,
    spec: PanelSpec | None = None,
    by: list[str] | None = None,
    *,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Spearman's rho per (by, season, period, group), over all and over played rows."""
    spec = spec or PanelSpec()
    group = [*(by or []), *spec.period_keys, spec.group]
    # -0.0 and 0.0 are one value, to windows as well as to a histogram.
    rows = _scored(results).select(
        *group,
        F.coalesce(F.col(spec.exposure) > 0, F.lit(False)).alias("_played"),
        (F.col("prediction").cast("double") + 0.0).alias("prediction"),
        (F.col("actual").cast("double") + 0.0).alias("actual"),
    )
    size = ordered.split_rows(rows, group, group_rows, plan)
    if size is not None:
        return _by_histogram(rows, group, size)
    return _by_window(rows, group)


def rank_correlation(
    results: DataFrame,
    spec: PanelSpec | None = None,
    by: list[str] | None = None,
    *,
    min_group: int = fixed_values.MIN_GROUP,
    group_rows: int | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Mean rho over groups that are large enough and have spread; null if none."""
    each = group_correlations(results, spec, by, group_rows=group_rows, plan=plan)

    def mean_of(rho: str, n: str) -> Column:
        return F.avg(F.when(F.col(n) >= min_group, F.col(rho)))

    return each.groupBy(*(by or [])).agg(
        mean_of("rho", "n").alias("rank_corr"),
        mean_of("rho_played", "n_played").alias("rank_corr_played"),
    )


def period_errors(
    results: DataFrame, spec: PanelSpec | None = None, by: list[str] | None = None
) -> DataFrame:
    """Per period: row counts and sums of absolute error, over all and played rows."""
    spec = spec or PanelSpec()
    error = F.abs(F.col("prediction") - F.col("actual"))
    played = F.col(spec.exposure) > 0
    return results.groupBy(*(by or []), *spec.period_keys).agg(
        F.count("*").alias("rows"),
        F.count(error).alias("scored"),
        F.sum(error).alias("error"),
        F.count(F.when(played, error)).alias("scored_played"),
        F.sum(F.when(played, error)).alias("error_played"),
    )


def period_hits(
    results: DataFrame,
    spec: PanelSpec | None = None,
    by: list[str] | None = None,
    k: int = fixed_values.TOP_K,
) -> DataFrame:
    """Per period: entities among both the k highest predicted and the k highest actual."""
    spec = spec or PanelSpec()
    keys = [*(by or []), *spec.period_keys]
    rows = _scored(results)

    def best(side: str) -> DataFrame:
        lean = rows.select(*keys, spec.entity, side)
        return ranks.top_k(lean, keys, side, spec.entity, k).select(*keys, spec.entity).distinct()

    both = best("prediction").join(best("actual"), [*keys, spec.entity])
    return both.groupBy(*keys).agg(F.count("*").alias("hits"))


def top_overlap(
    results: DataFrame,
    spec: PanelSpec | None = None,
    by: list[str] | None = None,
    k: int = fixed_values.TOP_K,
) -> DataFrame:
    """Mean share of the k highest predicted that are among the k highest actual."""
    return _summary(results, spec or PanelSpec(), by or [], k).select(
        *(by or []), f"top{k}_overlap"
    )


def _summary(results: DataFrame, spec: PanelSpec, by: list[str], k: int) -> DataFrame:
    keys = [*by, *spec.period_keys]
    periods = period_errors(results, spec, by).join(
        period_hits(results, spec, by, k), keys, "left"
    )
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(k))
    return periods.groupBy(*by).agg(
        F.count("*").alias("periods"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.avg(F.when(F.col("scored") >= 2 * k, share)).alias(f"top{k}_overlap"),
        F.try_divide(F.sum("error"), F.sum("scored")).alias("mae"),
        F.try_divide(F.sum("error_played"), F.sum("scored_played")).alias("mae_played"),
    )


def score(
    results: DataFrame,
    spec: PanelSpec | None = None,
    by: list[str] | None = None,
    *,
    k: int = fixed_values.TOP_K,
    on_scale: Column | bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per model: counts, rank agreement, overlap and error.

    Error is null where ``on_scale`` is false: a pure ranking has no unit to be
    wrong in.
    """
    spec = spec or PanelSpec()
    keys = by or ["_all"]
    table = results if by else results.withColumn("_all", F.lit(0))
    summary = _summary(table, spec, keys, k)
    agreement = rank_correlation(table, spec, keys, group_rows=group_rows)
    scale = on_scale if isinstance(on_scale, Column) else F.lit(on_scale)
    return summary.join(agreement, keys, "left").select(
        *(by or []),
        "periods",
        "rows",
        "rank_corr",
        "rank_corr_played",
        f"top{k}_overlap",
        F.when(scale, F.col("mae")).alias("mae"),
        F.when(scale, F.col("mae_played")).alias("mae_played"),
    )
