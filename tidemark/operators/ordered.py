"""Running totals and neighbours in groups too large for one task.

A window function hands each group to a single task. That is right for an
entity's season (a few dozen rows) and wrong for "all entities of one period"
once there are a billion entities. The functions here give the same answers by
cutting every large group into ordered buckets: split points come from a hash
sample of the group's own rows, each bucket is summed on its own, and the totals
of the buckets before it are added back.

The sample is taken by hash, not at random, so a recomputed task finds the same
split points after an executor is lost.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import counted, written

# Above this many rows per group the split path is taken.
WINDOW_GROUP_ROWS = 4_000_000

# A value shared by this many rows is joined by broadcast instead of by shuffle.
HOT_VALUE_ROWS = 1_000_000

# Buckets aimed at in the largest group.
BUCKETS_PER_GROUP = 1024

# The two plans by name, for callers that choose one themselves.
WINDOW, SPLIT = "window", "split"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group; one number reaches the driver."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def resolve_group_rows(df: DataFrame, keys: list[str], group_rows: int | None) -> int:
    """A bound the caller can prove, or else a measured one."""
    return largest_group(df, keys) if group_rows is None else group_rows


def split_rows(
    df: DataFrame, keys: list[str], group_rows: int | None, plan: str | None = None
) -> int | None:
    """Bound on a group's rows if the split plan is to run, None for the window plan.

    ``plan`` names one of the two; both give the same rows. The bound of a split is
    the caller's or measured, never made up: split points are spaced by it.
    """
    if plan not in (None, WINDOW, SPLIT):
        raise ValueError(f"plan is {WINDOW!r} or {SPLIT!r}, not {plan!r}")
    if plan == WINDOW:
        return None
    rows = resolve_group_rows(df, keys, group_rows)
    return rows if plan == SPLIT or rows > WINDOW_GROUP_ROWS else None


def sample_step(group_rows: int) -> int:
    return max(2, group_rows // BUCKETS_PER_GROUP)


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join in which a null key equals a null key, as it does when grouping."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def _bucket_of(marks: Column, at: Column) -> Column:
    """How many split points are at or before ``at``, by halving.

    As many steps as the number of split points has binary digits, however many.
    """
    digits = F.length(F.bin(F.size(marks).cast("long")))
    steps = F.transform(
        F.sequence(digits - 1, F.lit(0), F.lit(-1)),
        lambda bit: F.call_function("shiftleft", F.lit(1), bit),
    )

    def halve(seen: Column, step: Column) -> Column:
        reached = F.get(marks, seen + step - F.lit(1)) <= at
        return F.when(reached, seen + step).otherwise(seen)

    return F.when(marks.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), halve))


def with_bucket(df: DataFrame, keys: list[str], order: list[Column], step: int) -> DataFrame:
    """Add ``_at`` (the ordering value) and ``_bucket``, ordered within each group.

    About one row in ``step`` becomes a split point. Groups smaller than that
    mostly get none and stay whole in bucket 0.
    """
    placed = df.withColumn("_at", F.struct(*order))
    chosen = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col("_at")), F.lit(step)) == 0
    marks = (
        placed.where(chosen)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_at")).alias("_marks"))
    )
    marks = counted(marks, "split-points", F.size("_marks"))
    # One number: split points come one in ``step`` rows, so far more of them mean that
    # the bound was too low, and a bucket would grow with the group.
    most = marks.agg(F.max(F.size("_marks"))).first()[0] or 0
    if most > 4 * BUCKETS_PER_GROUP:
        raise ValueError(
            f"a group has {most} split points, {BUCKETS_PER_GROUP} were aimed at: "
            "group_rows is below its true size"
        )
    joined = matched(placed, marks, keys, "left")
    return joined.withColumn("_bucket", _bucket_of(F.col("_marks"), F.col("_at"))).drop("_marks")


def with_totals_before(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    totals: dict[str, Column],
    group_rows: int,
) -> DataFrame:
    """Add, per name in ``totals``, the sum over the group's earlier rows.

    ``order`` must be unique inside a group. A sum over no rows is null, as in a
    window that ends one row before the current one. The input is written once,
    since the sample, the buckets and their totals all read it.
    """
    split = with_bucket(written(df, "ordered"), keys, order, sample_step(group_rows))
    slot = [*keys, "_bucket"]
    inside = Window.partitionBy(*slot).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = split.select(
        "*", *[F.sum(value).over(inside).alias(f"_in_{name}") for name, value in totals.items()]
    )

    per_bucket = split.groupBy(*slot).agg(
        *[F.sum(value).alias(f"_of_{name}") for name, value in totals.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.select(
        *slot, *[F.sum(f"_of_{name}").over(earlier).alias(f"_to_{name}") for name in totals]
    )

    # About a thousand rows a group: broadcast where that proves few in all.
    joined = matched(local, counted(carried, "bucket-totals"), slot, "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(
                F.col(f"_in_{name}") + F.col(f"_to_{name}"),
                F.col(f"_in_{name}"),
                F.col(f"_to_{name}"),
            ).alias(name)
            for name in totals
        ],
    )


def join_per_value(
    df: DataFrame, values: DataFrame, keys: list[str], value: str, rows: str, out: str, *, stored: bool = False
) -> DataFrame:
    """Add ``out`` from a table with one row per (keys, value); ``rows`` is how often it occurs.

    Three parts, so that no shuffle sends a hot value to one task: values with
    many rows are few by arithmetic and go by broadcast, rows without a value need
    no join, and what is left shuffles on (keys, value). Without hot values, which the
    table tells before anything is joined, there is no such part. ``stored`` says that
    ``values`` is a written table already.
    """
    on = [*keys, value]
    table = values if stored else written(values.select(*on, rows, out), "per-value")
    is_hot = F.col(rows) >= HOT_VALUE_ROWS
    columns = [*df.columns, out]
    filled = df.where(F.col(value).isNotNull())
    empty = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast(table.schema[out].dataType))
    cold = table.where(~is_hot).select(*on, out)
    parts = [empty.select(*columns)]
    if not table.where(is_hot).isEmpty():
        hot = counted(table.where(is_hot).select(*on, out), "hot-values")
        parts.append(matched(filled, hot, on, "inner").select(*columns))
        filled = matched(filled, hot, on, "left_anti")
    joined = matched(filled, cold, on, "inner").select(*columns)
    for part in parts:
        joined = joined.unionByName(part)
    return joined
