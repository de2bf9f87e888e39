"""What each order of a set of filters removes, by recursive enumeration of the orders.

Every document is reduced to a mask, one bit for each filter it fails, and documents to
cells: counts per part and mask. A recursive common table expression then starts from
the masks that occur and extends a prefix of filters by each unused letter, carrying the
bits applied so far; each level of the recursion holds what its last filter meets in
each mask. Joined with the cells by mask this gives the figures of a step. The recursion
is bounded by the filters alone (325 prefixes and 32 masks), however many parts there
are; no document enters it.

Filter E needs the smallest key of each text. Texts are compared by 128 bits of hash and
length; rows of one text, mask, part and label are counted before they are shuffled, so a
text that a third of all rows share reaches the shuffle as a few rows of each task.

Nulls: a null text is empty, a null part the empty string. A row with a null key fails E
never and makes no other row fail it. Rows of one key and text are counted each, and fail
E only for a smaller key. Of several labels of a key any positive one counts; labels
without a key count for nothing. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of
from tidemark.session import written

LETTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = "[#$%&*|]"


def _text_masks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """_key, part, digest and the bits of the filters that need only the text.

    The words of a text are worked out in a projection of their own, and the row of
    measures behind it, so that neither is repeated for each of its uses.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        body.alias("_body"),
        words_of(F.col(f"`{text}`")).alias("_words"),
    )
    capitals = F.octet_length("_body") - F.octet_length(F.translate("_body", CAPITALS, ""))
    failed = [
        F.size("_words") < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")).cast("long") < DISTINCT_PERCENT * F.size("_words").cast("long"),
        100 * capitals.cast("long") > CAPITAL_PERCENT * F.length("_body").cast("long"),
        F.col("_body").rlike(SIGNS),
    ]
    return rows.select(
        "_key", "part",
        F.xxhash64("_body").alias("d1"), F.xxhash64(F.lit("text"), "_body").alias("d2"),
        F.length("_body").alias("d3"),
        _bits(failed).alias("mask"),
    )


def _bits(failed: list[Column]) -> Column:
    total = F.lit(0)
    for i, condition in enumerate(failed):
        total = total + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    return total.cast("int")


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with good and toxic; one row of labels for each key."""
    of_key = (
        labels.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("_label_key"))
        .agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c[1:])
    return rows.join(of_key, F.col("_key") == F.col("_label_key"), "left").select(
        *rows.columns, flag("_good"), flag("_toxic"))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part by the filters they fail."""
    narrow = written(_text_masks(docs, key, text, part), "audit-masks")
    rows = _labelled(narrow, labels, key)
    same = ["d1", "d2", "d3", "mask", "part", "good", "toxic"]
    # Rows of one key first, then all keys of a text together: how many there are, and how
    # many of them have the least key.
    by_key = rows.groupBy(*same, "_key").agg(F.count("*").alias("n"))
    by_text = by_key.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_key").isNull(), F.col("n")).otherwise(0)).alias("keyless"),
        F.min(F.when(F.col("_key").isNotNull(), F.struct(F.col("_key").alias("key"), "n"))).alias("first"),
    )
    # A text has as many rows left as it has parts and labels.
    by_text = written(by_text, "audit-texts")
    least = by_text.groupBy("d1", "d2", "d3").agg(F.min("first.key").alias("least"), F.count("*").alias("rows"))
    single = F.col("first.n")
    spread = by_text.join(least.where("rows > 1").select("d1", "d2", "d3", "least"), ["d1", "d2", "d3"], "left")
    stay = F.col("keyless") + F.when(F.col("least").isNull() | (F.col("first.key") == F.col("least")), single).otherwise(0)
    stay = F.coalesce(stay, F.col("keyless"))
    last = 1 << LETTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), stay.alias("n")),
        F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - stay).alias("n")),
    )
    return (
        spread.select("part", "good", "toxic", F.inline(both)).where("n > 0")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    )


# The same text runs in Spark and, but for the two generators, in DuckDB.
_WALK = """
walk(prefix, step, applied, bit, mask) AS (
  SELECT '', 0, 0, 0, mask FROM (SELECT DISTINCT mask FROM {cells})
  UNION ALL
  SELECT concat(prefix, f.letter), step + 1, applied | f.bit, f.bit, mask
  FROM ({unused}) AS unused WHERE step < {size}),
levels AS (
  SELECT c.part, w.prefix, w.step,
         sum(CASE WHEN w.mask & w.applied = 0 THEN c.n ELSE 0 END) AS kept,
         sum(CASE WHEN w.mask & w.applied = w.bit THEN c.n ELSE 0 END) AS removed,
         sum(CASE WHEN w.mask & w.bit <> 0 AND w.mask & w.applied <> w.bit THEN c.n ELSE 0 END) AS redundant,
         sum(CASE WHEN w.mask = w.bit THEN c.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN w.mask & w.applied = w.bit THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN w.mask & w.applied = w.bit THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM walk w JOIN {cells} c ON c.mask = w.mask WHERE w.step > 0 GROUP BY c.part, w.prefix, w.step),
orders AS (
  SELECT prefix AS filter_order, {places} AS step FROM (SELECT DISTINCT prefix FROM walk WHERE step = {size}) AS whole)
SELECT l.part, o.filter_order, CAST(o.step AS INTEGER) AS step, CAST(l.kept AS BIGINT) AS kept,
       CAST(l.removed AS BIGINT) AS removed, CAST(l.redundant AS BIGINT) AS redundant,
       CAST(l.unique_fails AS BIGINT) AS unique_fails, CAST(l.good_lost AS BIGINT) AS good_lost,
       CAST(l.toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(l.removed) OVER (PARTITION BY l.part, substring(o.filter_order, o.step, 1)) AS BIGINT) AS shapley
FROM orders o JOIN levels l ON l.prefix = substring(o.filter_order, 1, o.step)
"""


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all ``letters`` and step, from cells of part and mask."""
    spark = counted.sparkSession
    bits = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    unused = (f"SELECT prefix, step, applied, mask, explode(filter(array({bits}), f -> applied & f.bit = 0)) AS f "
              "FROM walk")
    text = _WALK.format(cells="{cells}", unused=unused, size=len(letters), places=f"explode(sequence(1, {len(letters)}))")
    return spark.sql("WITH RECURSIVE " + text, cells=counted)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The figures of every order of the five filters, for each part."""
    return interactions(written(cells(docs, labels, key, text, part), "audit-cells"))


def sql(documents: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the rows of :func:`audit`."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    unused = ("SELECT prefix, step, applied, mask, f FROM walk JOIN "
              f"(SELECT {{'letter': letter, 'bit': bit}} AS f FROM (VALUES {letters}) AS v(letter, bit)) ON applied & f.bit = 0")
    return f"""
WITH RECURSIVE marks AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM {documents}),
label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM {labels} GROUP BY doc_id),
cells AS (
  SELECT part,
         (CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(body) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(body, '{SIGNS}') THEN 8 ELSE 0 END)
         + (CASE WHEN m.doc_id > least THEN 16 ELSE 0 END) AS mask,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marks m LEFT JOIN label USING (doc_id) GROUP BY ALL),
{_WALK.format(cells="cells", unused=unused, size=len(LETTERS), places=f"unnest(range(1, {len(LETTERS) + 1}))").lstrip()}"""
