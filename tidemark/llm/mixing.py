"""Interleaving sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block`` units (characters of text plus one for each
document). With ``share`` of ``period`` slots, block k of a source (from 0) may not come
before slot floor(k * period / share) and must come before ceil((k + 1) * period / share);
in each slot the released block with the earliest deadline is taken, ties to the smaller
source name. The shares add up to the period, so every slot is used, every deadline is
met, and after any number of slots no source is a whole block ahead of or behind its
weight. All sources are level again after one period, so one period's slots are worked
out once, by a fold over its slots, and the blocks of every later period are placed by
arithmetic: nothing is scheduled row by row. When a source has run out its slots stay
empty and the others keep their order and relative weights; no document is dropped,
cut or repeated.

Weights are given, or follow the sources' sizes to the power one half, in whole numbers.
Each source gets at least one slot of the period.

The size before each document is summed in two levels: a source's documents are spread by
the digest of their key over about the square root of their number of buckets, buckets
are summed, and a window runs inside each bucket, so a source with most of the rows is
split evenly.

Nulls: a null source is a source of its own, before all names; a null text is empty and
takes one unit; rows with a null key come last in their source, those with repeated keys
one after the other. Rows that share a place (equal key and size) are told apart by
nothing, so which of them comes first is not defined. Empty tables give empty results.
Other columns are ignored by ``schedule`` and kept by ``interleave``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed
from tidemark.session import counted, written

BLOCK = 65_536
PERIOD = 1024

def _placed(rows: DataFrame, key: Column, text: Column, source: Column) -> DataFrame:
    """``rows`` with _source, _size, and _order: hex digest of the key, null keys last."""
    return rows.select(
        "*",
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("_source"),
        (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.md5(key.cast("string")), F.lit("g")).alias("_order"),
    )


def _bucket() -> Column:
    """Bucket of a document: the leading digits of its digest, scaled; null keys last."""
    leading = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    return F.when(F.col("_order") == "g", F.col("_buckets")).otherwise(
        F.floor(leading * F.col("_buckets") / F.lit(float(1 << 32)))
    ).cast("long")


def sizes(rows: DataFrame) -> DataFrame:
    """_source, _units and _buckets of each source; summed before the shuffle."""
    return rows.groupBy("_source").agg(
        F.sum("_size").alias("_units"),
        F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_buckets"),
    )


def shares(totals: DataFrame, weights: dict[str, int] | None = None, period: int = PERIOD) -> DataFrame:
    """_source and _share: whole slots of the period, by largest remainder.

    With more than a quarter as many sources as slots the period is that much longer.
    A source that ``weights`` does not name has weight zero, so one slot.
    """
    if weights is None:
        weight = F.floor(F.sqrt(F.col("_units").cast("double"))).cast("long")
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit("=" + name), F.lit(int(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_source")] if pairs else F.lit(0), F.lit(0)).cast("long")
    # One row per source, so a window over all of them is as small as their number.
    every = Window.partitionBy("_k")
    table = totals.select("_source", weight.alias("_w"), F.lit(1).alias("_k")).select(
        "*", F.sum("_w").over(every).alias("_all"), F.count("*").over(every).alias("_n")
    ).withColumn("_period", F.greatest(F.lit(period).cast("long"), F.col("_n") * 4))
    free = "(_period - _n)"
    table = table.select(
        "*",
        F.expr(f"if(_all = 0, 0, (_w * {free}) div _all)").alias("_whole"),
        F.expr(f"if(_all = 0, 0, (_w * {free}) % _all)").alias("_rest"),
    )
    left = F.expr(f"{free}") - F.sum("_whole").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_rest"), F.asc("_source")))
    table = table.withColumn("_left", left).withColumn("_rank", rank)
    # Without any weight the slots left over are dealt out evenly.
    extra = F.expr("(_left div _n) + if(_rank <= _left % _n, 1, 0)")
    return table.select("_source", "_period", (1 + F.col("_whole") + extra).alias("_share"))


def template(table: DataFrame) -> DataFrame:
    """_source, _period, _share and _slots: the slots of its blocks in one period.

    A fold over the slots of one period, whose state is how many blocks each source has
    had; its size is the period times the number of sources, whatever the data.
    """
    # collect_list of one row per source.
    gathered = table.groupBy("_period").agg(
        F.sort_array(F.collect_list(F.struct("_source", "_share"))).alias("s")
    )
    # The state of a fold keeps its type, so picking and counting are one expression.
    fold = """
      aggregate(
        sequence(0L, _period - 1),
        named_struct('had', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
        (state, slot) -> transform(array(
          array_min(transform(
            filter(sequence(0, size(s) - 1),
                   i -> state.had[i] < s[i]._share and (state.had[i] * _period) div s[i]._share <= slot),
            i -> named_struct('due', ((state.had[i] + 1) * _period + s[i]._share - 1) div s[i]._share, 'i', i)
          )).i),
          pick -> named_struct(
            'had', transform(state.had, (h, i) -> if(i = pick, h + 1L, h)),
            'picks', array_append(state.picks, pick)))[0],
        state -> state.picks)"""
    picked = gathered.select("s", "_period", F.expr(fold).alias("picks"))
    return (
        picked.select("s", "_period", F.posexplode("picks").alias("_slot", "i"))
        .select(F.expr("s[i]").alias("x"), "_period", "_slot")
        .groupBy("x._source", "x._share", "_period")
        .agg(F.sort_array(F.collect_list("_slot")).alias("_slots"))
    )


def _scheduled(rows: DataFrame, narrow: DataFrame, weights, block: int, period: int) -> DataFrame:
    """``rows`` with _start (units before it in its source), _block and _slot.

    ``narrow`` has the same rows without their texts, for the sums.
    """
    totals = written(sizes(narrow), "mix-sources")
    plan = template(shares(totals, weights, period)).join(totals, "_source")
    plan = counted(plan.select("_source", "_share", "_period", "_slots", "_buckets"), "mix-plan",
                   F.size("_slots"))
    spread = narrow.join(plan.select("_source", "_buckets"), "_source").withColumn("_b", _bucket())
    before = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted(
        spread.groupBy("_source", "_b").agg(F.sum("_size").alias("_units"))
        .select("_source", "_b", F.coalesce(F.sum("_units").over(before), F.lit(0)).alias("_base")),
        "mix-buckets",
    )
    inside = (
        Window.partitionBy("_source", "_b").orderBy("_order", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = (
        rows.join(plan, "_source").withColumn("_b", _bucket())
        .withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    )
    at = F.col("_base") + F.col("_local")
    number = F.expr(f"_start div {block}")
    return (
        summed.join(bases, ["_source", "_b"])
        .withColumn("_start", at)
        .withColumn("_block", number)
        .withColumn("_slot", F.expr(
            "(_block div _share) * _period + element_at(_slots, cast(_block % _share as int) + 1)"))
    )


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK,
             period: int = PERIOD, key: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """key, source, units, start, block, slot and share (slots of a period) of each row.

    Sorting by slot and start gives the mixed stream.
    """
    c = lambda n: F.col(f"`{n}`")
    narrow = docs.select(c(key).alias("_key"), c(source).alias("_given"), c(text).alias("_text"))
    narrow = written(
        _placed(narrow, F.col("_key"), F.col("_text"), F.col("_given")).drop("_text"), "mix-sizes"
    )
    return _scheduled(narrow, narrow, weights, block, period).select(
        F.col("_key").alias(key), F.col("_given").alias(source), F.col("_size").alias("units"),
        F.col("_start").alias("start"), F.col("_block").alias("block"), F.col("_slot").alias("slot"),
        F.col("_share").alias("share"),
    )


def interleave(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK,
               period: int = PERIOD, key: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """The given rows in mixed order: files in name order, rows in file order."""
    c = lambda n: F.col(f"_row.`{n}`")
    rows = _placed(packed(docs), c(key), c(text), c(source))
    narrow = written(rows.drop("_row"), "mix-sizes")
    placed = _scheduled(rows, narrow, weights, block, period).select("_row", "_slot", "_start")
    return placed.repartitionByRange("_slot", "_start").sortWithinPartitions("_slot", "_start").select("_row.*")


def sql(documents: str = "documents", block: int = BLOCK, period: int = PERIOD) -> str:
    """DuckDB SQL for the rows of :func:`schedule` with weights by size."""
    return f"""
WITH RECURSIVE placed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, (coalesce(length(text), 0) + 1)::BIGINT AS units,
         coalesce(md5(doc_id::VARCHAR), 'g') AS ord
  FROM {documents}),
started AS (
  SELECT *, (coalesce(sum(units) OVER (PARTITION BY name ORDER BY ord, units
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM placed),
weighed AS (SELECT name, floor(sqrt(sum(units)::DOUBLE))::BIGINT AS w FROM placed GROUP BY name),
summed AS (
  SELECT name, w, (sum(w) OVER ())::BIGINT AS all_, count(*) OVER () AS n,
         greatest({period}, 4 * count(*) OVER ()) AS period FROM weighed),
whole AS (SELECT *, (w * (period - n)) // all_ AS whole, (w * (period - n)) % all_ AS rest FROM summed),
ranked AS (
  SELECT *, (period - n - sum(whole) OVER ())::BIGINT AS left_,
         row_number() OVER (ORDER BY rest DESC, name) AS rank FROM whole),
shared AS (
  SELECT name, period, (1 + whole + left_ // n + CASE WHEN rank <= left_ % n THEN 1 ELSE 0 END)::BIGINT AS share,
         row_number() OVER (ORDER BY name) AS i FROM ranked),
lists AS (SELECT list(share ORDER BY i) AS s, max(period)::BIGINT AS period FROM shared),
fold AS (
  SELECT 0::BIGINT AS slot, list_transform(s, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick, s, period FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(s) + 1), lambda i: had[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, s, period
  FROM (SELECT *, list_min(list_transform(
          list_filter(range(1, len(s) + 1), lambda i: had[i] < s[i] AND (had[i] * period) // s[i] <= slot),
          lambda i: {{'due': ((had[i] + 1) * period + s[i] - 1) // s[i], 'i': i}})).i AS p
        FROM fold WHERE slot < period)),
slots AS (
  SELECT pick AS i, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k
  FROM fold WHERE slot > 0)
SELECT doc_id, source, units, start, start // {block} AS block,
       ((start // {block}) // share) * period + slots.slot AS slot, share
FROM started JOIN shared USING (name)
JOIN slots ON slots.i = shared.i AND slots.k = (start // {block}) % share
"""
