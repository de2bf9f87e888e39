"""CSV records with line breaks inside quotes, read in parallel from split files.

Where a record starts cannot be told from a line alone: it depends on whether the quotes
before it are closed. Seen as a function of that state, every line does one of four things:
leaves it, inverts it, or sets it to open or to closed. Such functions chain, so each split
is read under both states at once; the few numbers that a split ends with are chained over
the splits of its file, which settles the state each of them starts in; and that picks one
of the two readings. Lines that are whole records go on as they are, the others are joined,
by the split and number of the record they belong to, also across splits.

A quote opens a field only at its start. Inside, two quotes are one; what follows a closing
quote belongs to the field up to the next comma. Lines end with a line feed, with or without
a carriage return before it. Blank records are left out. A quote that is never closed makes
the rest of its file one record, as it does for a reader of whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import counted, written

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
# From a closed state to a closed one, and from an open state to a closed one.
_CLOSED_TO_CLOSED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_OPEN_TO_CLOSED = rf'\A(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+\z'


def ends_open(line: Column, from_open: bool = False) -> Column:
    """Is a quoted field open at the end of a line, if one was (not) open before it?"""
    quotes = F.contains(line, F.lit('"'))
    if from_open:
        return ~(quotes & line.rlike(_OPEN_TO_CLOSED))
    return quotes & ~line.rlike(_CLOSED_TO_CLOSED)


def _after(base: Column, flips: Column, fixed: Column) -> Column:
    """The state after lines that ``flips`` inverted since, if any, ``fixed`` set it.

    States are 0 and 1. ``fixed`` holds the state set by the last line that set one, less
    the flips up to it, so that all flips may be added.
    """
    return F.pmod(F.coalesce(fixed, base) + flips, F.lit(2))


def _read_both_ways(lines: DataFrame) -> DataFrame:
    """Per line, under both states at the start of its split: does it start a record, does the
    next line, how many started up to it, and the state after it."""
    of_split = ["file", "split"]
    order = Window.partitionBy(*of_split).orderBy("at")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    closed_in, open_in = ends_open(F.col("value")).cast("int"), ends_open(F.col("value"), True).cast("int")
    each = lines.withColumns({"_from0": closed_in, "_from1": open_in})
    each = each.withColumn("_flips", F.sum(F.when((F.col("_from0") == 1) & (F.col("_from1") == 0), 1).otherwise(0)).over(up_to))
    sets = F.when(F.col("_from0") == F.col("_from1"), F.pmod(F.col("_from0") - F.col("_flips"), F.lit(2)))
    each = each.withColumn("_fixed", F.last(sets, ignorenulls=True).over(up_to))
    each = each.withColumns({f"_end{s}": _after(F.lit(s), F.col("_flips"), F.col("_fixed")) for s in (0, 1)})
    each = each.withColumns({f"_starts{s}": F.lag(f"_end{s}", 1, s).over(order) == 0 for s in (0, 1)})
    return each.select(
        *of_split, "at", "value",
        *[F.struct(F.col(f"_starts{s}").alias("starts"), F.lead(f"_starts{s}").over(order).alias("next"),
                   F.sum(F.col(f"_starts{s}").cast("long")).over(up_to).alias("number"),
                   F.col(f"_end{s}").alias("end")).alias(f"from{s}") for s in (0, 1)],
    )


def _settled(read: DataFrame) -> DataFrame:
    """One row a split: the state it starts in, and the last record started before it."""
    last = lambda s: F.max_by(F.struct(f"from{s}.number", f"from{s}.end"), "at").alias(f"last{s}")
    splits = read.groupBy("file", "split").agg(last(0), last(1))
    # As many rows for a file as it has splits.
    order = Window.partitionBy("file").orderBy("split")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    from0, from1 = F.col("last0.end"), F.col("last1.end")
    splits = splits.withColumn("_flips", F.sum(F.when((from0 == 1) & (from1 == 0), 1).otherwise(0)).over(up_to))
    splits = splits.withColumn("_fixed", F.last(F.when(from0 == from1, F.pmod(from0 - F.col("_flips"), F.lit(2))), True).over(up_to))
    splits = splits.withColumn("state", F.lag(_after(F.lit(0), F.col("_flips"), F.col("_fixed")), 1, 0).over(order))
    started = F.when(F.col("state") == 0, F.col("last0.number")).otherwise(F.col("last1.number"))
    own = F.when(started > 0, F.struct(F.col("split").alias("split"), started.alias("number")))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return splits.select("file", "split", "state", before.alias("before"))


def records(spark: SparkSession, path: str | list[str], charset: str = "UTF-8") -> DataFrame:
    """file, split and number (where the record starts) and its text, blank ones left out."""
    raw = F.col("value").cast("binary")
    text = F.make_valid_utf8("value") if charset == "UTF-8" else F.decode(raw, charset)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), text.alias("value"))
    read = written(_read_both_ways(lines), "csv-lines")
    splits = counted(_settled(read), "csv-splits")
    own = F.when(F.col("state") == 0, F.col("from0")).otherwise(F.col("from1"))
    placed = read.join(splits, ["file", "split"]).withColumn("_own", own).select(
        "file",
        F.when(F.col("_own.number") > 0, F.struct("split", "_own.number")).otherwise(F.col("before")).alias("record"),
        "split", "at", "value", (F.col("_own.starts") & F.coalesce("_own.next", F.lit(False))).alias("whole"))
    single = placed.where("whole").select("file", "record.split", "record.number", "value")
    # As many lines for a record as it has.
    several = placed.where("not whole").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("split", "at", "value"))).alias("lines"))
    joined = several.select("file", "record.split", "record.number", F.array_join("lines.value", "\n").alias("value"))
    bare = F.regexp_replace("value", r"\r\z", "")
    return single.unionByName(joined).withColumn("value", bare).where(F.trim("value") != "")


def read_csv(spark: SparkSession, path: str, charset: str, place: str) -> DataFrame:
    """All fields as strings under the header of the first file, and ``place``, which orders rows.

    Extra fields are dropped and short records padded, as by a reader of whole files.
    """
    options = {"header": "true", "escape": '"', "multiLine": "true", "encoding": charset}
    names = spark.read.options(**options).csv(path).columns  # reads one record
    found = records(spark, path, charset)
    order = F.struct("split", "number")
    # The first record of each file is its header.
    found = found.withColumn("_place", order)
    heads = counted(found.groupBy("file").agg(F.min("_place").alias("_head")), "csv-heads")
    body = found.join(heads, "file").where(F.col("_place") != F.col("_head"))
    shape = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = body.select(F.struct("file", "_place").alias("_p"), F.from_csv("value", shape, {"escape": '"'}).alias("_f"))
    return parsed.select(*[F.col(f"_f.c{i}").alias(n) for i, n in enumerate(names)], F.col("_p").alias(place))
