"""Removal of lines that many documents hold, as bitmaps instead of texts.

A line's key is the line without ASCII blanks at both ends, A-Z in lower case. A key of
``min_chars`` code points or more that ``min_docs`` documents hold stays in the one with
the largest key and goes from all others. Only 128 bits of hash, the document and the
place of a line are moved: they are partitioned by ranges of the hash, sorted inside a
partition by hash, document (largest first) and place, and read as a stream in which the
first document of a hash keeps its lines. What comes back for a document is a bitmap of
its lines in 64-bit words, without the words that follow its last removed line.

A hash that very many lines share would be one group of that stream. Such hashes are found
by a mergeable sketch of frequent items, at most ``HOT_LIMIT`` of them, and decided without
moving their lines: largest and smallest document, and whether there is one between, are
aggregates that each task forms before the shuffle. Hashes that the sketch leaves out hold
a bounded share of all lines.

A row is known by its key and a 128-bit hash of key and text, so no row numbers are needed
and a task that runs again gives the same rows. Everything is built-in functions.

A null or empty text is one empty line. Rows of one key are one document; rows without a
key are one too, smaller than all others. Repeated rows come back once each. An empty
table gives an empty result. ``clean`` keeps other columns, the rest ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed
from tidemark.session import written

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A hash leaves the stream if it is frequent and has more than one in HOT_SHARE of all lines
# (or HOT_MOST lines, whatever their number).
HOT_SHARE, HOT_MOST = 1000, 1_000_000
# Sketches of frequent hashes: groups, hashes taken from each, and hashes tracked by each.
HOT_GROUPS, HOT_EACH, HOT_TRACKED = 16, 64, 1024
HOT_LIMIT = HOT_GROUPS * HOT_EACH

WORD = 64


def _body(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _identity(key: Column, text: Column) -> list[Column]:
    """Two longs that stand for a row's key and text."""
    parts = [key.isNull(), key, text.isNull(), text]
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit("row"), *parts).alias("r2")]


def line_hashes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2, _key, r1, r2 and pos of every line long enough to be compared."""
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    lower = F.translate(_body(body), CAPITALS, CAPITALS.lower())
    each = docs.select(
        own.alias("_key"), *_identity(own, body), F.posexplode(F.split(lower, "\n")).alias("pos", "_line"))
    line = F.btrim("_line", F.lit(BLANK))
    return (
        each.select("_key", "r1", "r2", "pos", line.alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select(F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit("line"), "_line").alias("h2"),
                "_key", "r1", "r2", "pos")
    )


def frequent(lines: DataFrame, hot_lines: int) -> list[int]:
    """Hashes that more than ``hot_lines`` lines seem to share, ``HOT_LIMIT`` at most."""
    top = lines.groupBy(F.pmod("h1", F.lit(HOT_GROUPS)).alias("g")).agg(
        F.expr(f"approx_top_k(h1, {HOT_EACH}, {HOT_TRACKED})").alias("top"))
    rows = top.select(F.inline("top")).where(F.col("count") > hot_lines)
    return [r["item"] for r in rows.collect()]


def _streamed(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop, from a stream ordered by hash, document and place."""
    larger_first = F.col("_key").desc_nulls_last()
    in_range = lines.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", larger_first, "pos")
    group = Window.partitionBy("h1", "h2")
    place = F.dense_rank().over(group.orderBy(larger_first))
    ranked = in_range.withColumn("_nth", place).withColumn("_docs", F.max("_nth").over(group))
    return ranked.where((F.col("_nth") > 1) & (F.col("_docs") >= min_docs)).select("r1", "r2", "pos")


def _summed(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop of hashes held by very many lines; nothing but sums is shuffled.

    The first round takes the largest document of each hash; every further round the
    largest of those below the ones taken, until ``min_docs`` are known or none is left.
    """
    doc = F.struct(F.col("_key").alias("k"))
    known = written(lines.groupBy("h1", "h2").agg(F.max(doc).alias("first")).withColumn("low", F.col("first")), "lines-hot")
    for _ in range(min_docs - 1):
        below = lines.join(F.broadcast(known), ["h1", "h2"]).where(doc < F.col("low"))
        known = written(below.groupBy("h1", "h2", "first").agg(F.max(doc).alias("low")), "lines-hot")
    return lines.join(F.broadcast(known), ["h1", "h2"]).where(doc < F.col("first")).select("r1", "r2", "pos")


def _words(dropped: DataFrame) -> DataFrame:
    """r1, r2, n_dropped and keep: an array of 64-bit words, a set bit for a kept line."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(WORD)).cast("int"))
    of_word = dropped.groupBy("r1", "r2", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    # As many words for a row as its lines need.
    of_row = of_word.groupBy("r1", "r2").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("some"),
    )
    before = lambda i: F.coalesce(F.get("some", i - 1)["word"], F.lit(-1))
    filled = F.flatten(F.transform("some", lambda x, i: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), x["word"] - F.when(i > 0, before(i)).otherwise(-1) - 1), F.array(x["bits"]))))
    return of_row.select("r1", "r2", "n_dropped", filled.alias("keep"))


def _removed(docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int, hot_lines: int | None) -> DataFrame:
    """One row for each key and text that loses a line."""
    lines = written(line_hashes(docs, key, text, min_chars), "lines-hashes")
    if hot_lines is None:
        hot_lines = min(max(lines.count() // HOT_SHARE, HOT_SHARE), HOT_MOST)
    hot = frequent(lines, hot_lines)
    dropped = _streamed(lines.where(~F.col("h1").isin(hot)) if hot else lines, min_docs)
    if hot:
        dropped = dropped.union(_summed(lines.where(F.col("h1").isin(hot)), min_docs))
    return written(_words(dropped), "lines-bitmaps")


def _with_bitmap(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Bitmaps are much smaller than the rows they join, so they are the side that is hashed."""
    return rows.join(found.hint("shuffle_hash"), ["r1", "r2"], "left")


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
            min_docs: int = MIN_DOCS, hot_lines: int | None = None) -> DataFrame:
    """key, n_lines, n_dropped and keep of every row; lines past the end of ``keep`` stay."""
    found = _removed(docs, key, text, min_chars, min_docs, hot_lines)
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    n_lines = F.length(_body(body)) - F.length(F.replace(_body(body), F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(own.alias("_key"), n_lines.cast("long").alias("n_lines"), *_identity(own, body))
    return _with_bitmap(rows, found).select(
        F.col("_key").alias(key), "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("keep", F.expr("cast(array() as array<bigint>)")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` whose bit in ``keep`` is set, and those past its end."""
    def stays(_, at: Column) -> Column:
        word = F.coalesce(F.get(keep, F.call_function("shiftright", at, F.lit(6))), F.lit(-1).cast("long"))
        return F.call_function("shiftright", word, at % WORD).bitwiseAND(1) == 1

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS, hot_lines: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, and n_dropped; texts that lose nothing unchanged."""
    found = _removed(docs, key, text, min_chars, min_docs, hot_lines)
    own, body = F.col(f"_row.`{key}`"), F.col(f"_row.`{text}`")
    rows = packed(docs).select("_row", *_identity(own, body))
    new = F.when(F.col("n_dropped").isNull(), body).otherwise(kept_text(_body(body), F.col("keep")))
    return _with_bitmap(rows, found).select(
        *[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
            min_docs: int = MIN_DOCS, hot_lines: int | None = None) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256, the digest of the text that is left."""
    found = _removed(docs, key, text, min_chars, min_docs, hot_lines)
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(own.alias("_key"), _body(body).alias("_text"), *_identity(own, body))
    n_lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    new = F.when(F.col("n_dropped").isNull(), F.col("_text")).otherwise(kept_text(F.col("_text"), F.col("keep")))
    return _with_bitmap(rows, found).select(
        F.col("_key").alias(key), n_lines.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(new.cast("binary"), 256).alias("kept_sha256"))


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`digests`."""
    blank = " || ".join(f"chr({ord(c)})" for c in BLANK)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}),
each AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM base),
keyed AS (
  SELECT *, translate(trim(line, {blank}), '{CAPITALS}', '{CAPITALS.lower()}') AS k FROM each),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {MIN_DOCS}),
marked AS (
  SELECT rid, doc_id, line, pos, o.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone
  FROM keyed LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
