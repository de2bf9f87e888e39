"""Quality rules whose limits adapt to each language and source.

Every text is measured with built-in functions. A quantile sketch per (language,
source) and measure is a histogram over integer log-linear bins: below 64 each value
has its own bin, above that a bin spans 1/32 of its value. Such sketches merge by
adding counts, in any order and with the same result, so they are a plain grouped
sum: no group is ever gathered, and a source with a third of all rows is summed
before it is shuffled. Groups with fewer than ``min_group`` texts take the limits of
their language's merged sketch, small languages those of all texts.

Nulls: a null text has no words (and so fails); a null language or source is the same
group as the empty string. Repeated rows count and come back once each. An empty
table gives an empty result. Other columns are ignored by ``measure`` and kept by
``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, words_of
from tidemark.session import counted, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Lines with a word: what repeated lines are held against.
LINES = "n_lines"

# Bins: values below FINE one by one, then FINE / 2 bins for each doubling.
FINE = 64


@dataclass(frozen=True)
class Measure:
    """A ratio in whole thousandths (hundredths for letters) and its least leeway.

    A text is outside if it lies beyond the median by more than ``spread`` times the
    distance to the quartile on that side plus ``leeway``. Leeways of repeats lie well
    below the fixed rule; a single repeat, which weighs much in a short text, counts for
    nothing: one line, or one window of ``WINDOW`` words met twice.
    """

    name: str
    count: str
    scale: int
    leeway: int
    both_sides: bool = False
    of: str = "n_words"


MEASURES = (
    Measure("word_length", "word_chars", 100, 300, both_sides=True),
    Measure("symbols", "n_symbols", 1000, 100),
    Measure("dup_lines", "greatest(n_dup_lines - 1, 0)", 1000, 200, of=LINES),
    Measure("repeats", f"greatest(n_repeat_words - {2 * WINDOW}, 0)", 1000, 150),
)
SPREAD = 8
MIN_GROUP = 100
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``_row``, the five counts of its text and its lines.

    Each step is a projection of its own, since the later ones use it several times.
    """
    body = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    rows = packed(docs).select(
        "_row",
        words_of(F.col(f"_row.`{text}`")).alias("_words"),
        (F.octet_length(body) - F.octet_length(F.regexp_replace(body, SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    rows = rows.select(
        "_row",
        "n_symbols",
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias(LINES),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_h"),
    )
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words from their halves
        rows = rows.withColumn("_h", F.transform("_h", lambda h, at: F.xxhash64(h, F.get("_h", at + step))))
    # The last seven windows are short ones, of as many words as are left; as no two of
    # those are of one length, they equal no other.
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    counts = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(repeated, _covered(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        LINES,
    )
    # Filters on the counts stop at a generator; pushed below they would copy the
    # expressions above once for each use.
    return rows.select("_row", F.inline(F.array(counts)))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, the first included.

    Windows are sorted by hash, so equal ones are neighbours; the places of those are
    then sorted, and each adds the words up to the next, eight at most.
    """
    by_hash = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    twins = _bound(by_hash, lambda all_: F.transform(all_, lambda a, i: F.when(
        a["h"] == F.get(all_, i + 1)["h"], F.array(a["at"], F.get(all_, i + 1)["at"]))))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    steps = _bound(places, lambda all_: F.transform(all_, lambda a, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(all_, i + 1) - a, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def _value(m: Measure) -> Column:
    """Whole-number ratio; floor of a quotient of longs, without doubles."""
    return F.expr(f"({m.scale} * {m.count}) div greatest({m.of}, 1)")


def _bin(value: Column) -> Column:
    shift = F.length(F.bin(value)) - 6
    return F.when(value < FINE, value).otherwise(
        FINE + (shift - 1) * (FINE // 2)
        + F.call_function("shiftright", value, shift.cast("int")) - FINE // 2
    ).cast("int")


def _bin_top(bin_: Column) -> Column:
    """The largest value of a bin."""
    octave = F.floor((bin_ - FINE) / (FINE // 2)).cast("int") + 1
    step = (bin_ - FINE) % (FINE // 2) + FINE // 2 + 1
    return F.when(bin_ < FINE, bin_.cast("long")).otherwise(
        F.call_function("shiftleft", step.cast("long"), octave) - 1
    )


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """level, lang, source, measure, bin, n: one mergeable sketch per group and measure.

    Level 0 is one (language, source), level 1 a language, level 2 everything.
    """
    name = lambda c: F.coalesce(F.col(f"_row.`{c}`").cast("string"), F.lit(""))
    long = measured.where("n_words > 0").select(
        name(lang).alias("lang"),
        name(source).alias("source"),
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("measure"), _bin(_value(m)).alias("bin"))
            for i, m in enumerate(MEASURES)
        ])).alias("x"),
    ).select("lang", "source", "x.*")
    finest = long.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    all_ = F.lit("")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), all_.alias("s")),
        F.struct(F.lit(2).alias("level"), all_.alias("l"), all_.alias("s")),
    )
    return (
        finest.select(F.explode(levels).alias("g"), "measure", "bin", "n")
        .groupBy(F.col("g.level").alias("level"), F.col("g.l").alias("lang"),
                 F.col("g.s").alias("source"), "measure", "bin")
        .agg(F.sum("n").alias("n"))
    )


def _quantile(name: str, permille: int) -> Column:
    """Upper end of the bin that holds the rank; the bins are sorted and cumulated."""
    rank = F.expr(f"(total * {permille} + 999) div 1000")
    return _bin_top(F.filter("cumulated", lambda x: x["upto"] >= rank)[0]["bin"]).alias(name)


def limits(sketch: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and an array ``bounds`` of (low, high), one for each measure."""
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    running = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("upto"),
                 F.expr("cast(array() as array<struct<bin:int,upto:bigint>>)").alias("out")),
        lambda s, x: F.struct(
            (s["upto"] + x["n"]).alias("upto"),
            F.array_append(s["out"], F.struct(x["bin"].alias("bin"), (s["upto"] + x["n"]).alias("upto"))).alias("out"),
        ),
        lambda s: s["out"],
    )
    quartiles = (
        sketch.groupBy("level", "lang", "source", "measure")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        .select("level", "lang", "source", "measure", total.alias("total"), running.alias("cumulated"))
        .select("level", "lang", "source", "measure", "total",
                _quantile("q1", 250), _quantile("q2", 500), _quantile("q3", 750))
    )
    leeway = F.element_at(F.array(*[F.lit(m.leeway) for m in MEASURES]), F.col("measure") + 1)
    both = F.element_at(F.array(*[F.lit(m.both_sides) for m in MEASURES]), F.col("measure") + 1)
    q = F.col
    per_group = (
        quartiles.select(
            "level", "lang", "source", "measure", "total",
            F.when(both, q("q2") - (q("q2") - q("q1")) * spread - leeway).otherwise(F.lit(0)).alias("low"),
            (q("q2") + (q("q3") - q("q2")) * spread + leeway).alias("high"),
        )
        .groupBy("level", "lang", "source")
        .agg(F.max("total").alias("total"),
             F.transform(F.sort_array(F.collect_list(F.struct("measure", "low", "high"))),
                         lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("bounds"))
    )
    per_group = written(per_group, "quality-limits")
    own = per_group.where("level = 0").drop("level")
    of_lang = per_group.where("level = 1").select(
        "lang", F.col("total").alias("lang_total"), F.col("bounds").alias("lang_bounds"))
    # One row for all texts; without texts there is none, and no group either.
    of_all = per_group.where("level = 2").select("bounds").first()
    everywhere = F.array(*[F.struct(F.lit(b["low"]).alias("low"), F.lit(b["high"]).alias("high"))
                           for b in (of_all["bounds"] if of_all else [])])
    everywhere = everywhere.cast("array<struct<low:bigint,high:bigint>>")
    return (
        own.join(of_lang, "lang", "left")
        .select("lang", "source",
                F.when(F.col("total") >= min_group, F.col("bounds"))
                .when(F.col("lang_total") >= min_group, F.col("lang_bounds"))
                .otherwise(everywhere).alias("bounds"))
    )


def judge(measured: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; joined with its group's limits.

    The limits are one row per language and source: written, counted, and sent to all
    tasks only if few, else joined by shuffle, where adaptive execution splits a hot one.
    """
    small = counted(
        bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                      F.col("bounds").alias("_bounds")),
        "quality-bounds",
    )
    name = lambda c: F.coalesce(F.col(f"_row.`{c}`").cast("string"), F.lit(""))
    inside = F.lit(True)
    for i, m in enumerate(MEASURES):
        bound = F.col("_bounds")[i]
        inside = inside & (_value(m) <= bound["high"]) & (_value(m) >= bound["low"])
    return (
        measured.join(small, (name(lang) == F.col("_lang")) & (name(source) == F.col("_source")), "left")
        .select("_row", *COUNTS, base_failed().alias("base_failed"),
                (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"))
    )


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """key, the five counts, ``base_failed`` and ``kept`` for each row; texts are read once."""
    narrow = measure(docs, text).select(
        F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in dict.fromkeys([key, lang, source])]).alias("_row"),
        *COUNTS, LINES,
    )
    measured = written(narrow, "quality-measures")
    return judge(measured, limits(sketches(measured, lang, source)), lang, source).select(
        F.col(f"_row.`{key}`").alias(key), *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """The rows that are kept, unchanged. Texts are measured once for the limits and
    once for the verdict, which costs less than moving them would."""
    bounds = limits(sketches(measure(docs, text), lang, source))
    return judge(measure(docs, text), bounds, lang, source).where("kept").select("_row.*")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`quality` on the table or view ``documents``."""
    values = ", ".join(f"({i}, ({m.scale} * {m.count}) // greatest({m.of}, 1))" for i, m in enumerate(MEASURES))
    leeways = " ".join(f"WHEN {i} THEN {m.leeway}" for i, m in enumerate(MEASURES))
    sided = ", ".join(str(i) for i, m in enumerate(MEASURES) if m.both_sides)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {documents}),
places AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM base),
windows AS (SELECT rid, pos, words[pos:pos + {WINDOW - 1}] AS w FROM places),
twice AS (SELECT rid, pos FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - pos, {WINDOW}))) AS n_repeat_words
  FROM (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM twice) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)),
vals AS (
  SELECT lang, source, measure, v FROM counts, LATERAL (VALUES {values}) AS x(measure, v) WHERE n_words > 0),
bins AS (
  SELECT lang, source, measure,
         CASE WHEN v < {FINE} THEN v
              ELSE {FINE} + (length(bin(v)) - 7) * {FINE // 2} + (v >> (length(bin(v)) - 6)::BIGINT) - {FINE // 2} END AS b
  FROM vals),
levels AS (
  SELECT 0 AS level, lang, source, measure, b FROM bins
  UNION ALL SELECT 1, lang, '', measure, b FROM bins
  UNION ALL SELECT 2, '', '', measure, b FROM bins),
sketch AS (SELECT level, lang, source, measure, b, count(*) AS n FROM levels GROUP BY ALL),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
         CASE WHEN b < {FINE} THEN b
              ELSE ((((b - {FINE}) % {FINE // 2}) + {FINE // 2 + 1}) << (((b - {FINE}) // {FINE // 2}) + 1)) - 1 END AS top
  FROM sketch),
quartiles AS (
  SELECT level, lang, source, measure, max(total) AS total,
         min(top) FILTER (upto >= (total * 250 + 999) // 1000) AS q1,
         min(top) FILTER (upto >= (total * 500 + 999) // 1000) AS q2,
         min(top) FILTER (upto >= (total * 750 + 999) // 1000) AS q3
  FROM running GROUP BY ALL),
bounds AS (
  SELECT level, lang, source, measure, total,
         CASE WHEN measure IN ({sided}) THEN q2 - (q2 - q1) * {SPREAD} - (CASE measure {leeways} END) ELSE 0 END AS low,
         q2 + (q3 - q2) * {SPREAD} + (CASE measure {leeways} END) AS high
  FROM quartiles),
chosen AS (
  SELECT a.lang, a.source, a.measure,
         CASE WHEN a.total >= {MIN_GROUP} THEN a.low WHEN b.total >= {MIN_GROUP} THEN b.low ELSE c.low END AS low,
         CASE WHEN a.total >= {MIN_GROUP} THEN a.high WHEN b.total >= {MIN_GROUP} THEN b.high ELSE c.high END AS high
  FROM bounds a JOIN bounds b ON b.level = 1 AND b.lang = a.lang AND b.measure = a.measure
                JOIN bounds c ON c.level = 2 AND c.measure = a.measure
  WHERE a.level = 0),
outside AS (
  SELECT rid, bool_or(v > high OR v < low) AS out_
  FROM (SELECT rid, lang, source, measure, v FROM counts, LATERAL (VALUES {values}) AS x(measure, v) WHERE n_words > 0)
  JOIN chosen USING (lang, source, measure) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
         AND NOT coalesce(out_, false) AS kept
FROM counts LEFT JOIN outside USING (rid)
"""
