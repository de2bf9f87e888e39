"""Removal of passages that repeat across documents, by digests of their units.

Lines are cut at sentence ends into units of a few words or more; a unit is normalised (letters and digits in
lower case, everything else one space) and digested. Digests are grouped over the whole
corpus; the earliest occurrence, by key and then place, stays and every later one is a
repeat. Repeats are removed where they stand in a run: neighbouring units of one
document, all repeats (what has no letter or digit is no unit), of ``min_words``
words or more together. Short sentences that two documents share by chance stay.

First half of each 128-bit digest is counted, so only units that may occur twice or
more, a small part, are ranked by the whole digest; a unit that a third of all documents
hold is one row for each task before any shuffle, and its occurrences are joined, never
gathered.

A null text is empty. Null keys rank last, repeated keys by their written order. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed
from tidemark.session import written

MIN_WORDS = 25

# Sentences shorter than this repeat by chance; they go with the next one.
LONG_UNIT = 4

# The end of a unit: a line break, or blanks after the end of a sentence.
UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*(?:[.!?]+(?=\s)[^\S\n]*|[.!?]*(?:\n|\Z))")
OTHER = re.compile(r"[\W_]+")


def units(text: str) -> list[tuple[int, int, str]]:
    """start, end and normal form of each unit that has a letter or digit.

    A line's end closes a unit; a sentence's end does once the unit has ``LONG_UNIT``
    words. A sentence that long closes a unit whatever came before, so units are in step
    again soon after the start of a passage, wherever it stands.
    """
    out, start, parts, words = [], 0, [], 0
    for m in UNIT.finditer(text):
        normal = OTHER.sub(" ", m[0].lower()).strip()
        if normal:
            if not parts:
                start = m.start()
            parts.append(normal)
            words += normal.count(" ") + 1
        if parts and (words >= LONG_UNIT or m[0].endswith("\n") or m.end() == len(text)):
            out.append((start, m.end(), " ".join(parts)))
            parts, words = [], 0
    return out


def digest(normal: str) -> bytes:
    return hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SHAPE = "starts array<int>, ends array<int>, words array<int>, h1 array<long>, h2 array<long>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    for whole in batches:
        for low in range(0, whole.num_rows, 100):
            batch = whole.slice(low, 100)
            rows = []
            for text in batch.column(1).to_pylist():
                found = units(text or "")
                halves = np.frombuffer(b"".join(digest(n) for *_, n in found), "<i8").reshape(-1, 2)
                rows.append(([u[0] for u in found], [u[1] for u in found], [u[2].count(" ") + 1 for u in found],
                             halves[:, 0], halves[:, 1]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, ints) for c in columns[:3]], *[pa.array(c, longs) for c in columns[3:]]],
                names=["_key", "starts", "ends", "words", "h1", "h2"],
            )


def runs(repeated: list[int], starts: list[int], ends: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int, int]]:
    """start, end, units and words of each run of neighbouring repeats that is long enough."""
    out, at = [], 0
    repeated = sorted(repeated)
    while at < len(repeated):
        to = at
        while to + 1 < len(repeated) and repeated[to + 1] == repeated[to] + 1:
            to += 1
        first, last = repeated[at], repeated[to]
        total = sum(words[first : last + 1])
        if total >= min_words:
            out.append((starts[first], ends[last], last - first + 1, total))
        at = to + 1
    return out


def _found(docs: DataFrame, key: str, text: str, min_words: int, rid: str | None = None) -> DataFrame:
    """_rid, _key, n_units, n_removed, removed_chars and spans of each row."""
    given = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"),
                        *([F.col(rid).alias("_rid")] if rid else []))
    kind = given.schema["_key"].dataType.simpleString()
    if rid:
        # The row's number goes with its key through Python.
        given = given.select(F.struct("_rid", "_key").alias("_key"), "_text")
        kind = f"struct<_rid:bigint,_key:{kind}>"
    cut = given.select("_key", "_text").mapInArrow(_units, f"_key {kind}, {_SHAPE}")
    if rid:
        cut = cut.select("_key._rid", "_key._key", *[c.split()[0] for c in _SHAPE.split(", ")])
    else:
        cut = cut.withColumn("_rid", F.monotonically_increasing_id())
    cut = written(cut, "lines-units")

    # Half the digest first: it decides which units can repeat at all.
    often = written(
        cut.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"),
        "lines-often",
    )
    each = cut.select("_rid", "_key", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select(
        "_rid", "_key", "at", "h.h1", "h.h2")
    shared = written(each.join(often, "h1"), "lines-shared")
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("k"), "_rid", "at")
    first = written(
        shared.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("h1", "h2", F.col("first._rid").alias("r"), F.col("first.at").alias("a")),
        "lines-first",
    )
    later = shared.join(first, ["h1", "h2"]).where((F.col("_rid") != F.col("r")) | (F.col("at") != F.col("a")))
    # As many entries for a document as it has units.
    of_document = later.groupBy("_rid").agg(F.collect_list("at").alias("repeated"))

    @F.pandas_udf("array<struct<start:int,end:int,units:int,words:int>>")
    def spans(repeated: pd.Series, starts: pd.Series, ends: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([
            [] if r is None else [dict(start=s, end=e, units=n, words=m) for s, e, n, m in
                                  runs(r.tolist(), a.tolist(), b.tolist(), w.tolist(), min_words)]
            for r, a, b, w in zip(repeated, starts, ends, words)
        ])

    joined = cut.select("_rid", "_key", "starts", "ends", "words").join(of_document, "_rid", "left")
    total = lambda f: F.aggregate("spans", F.lit(0).cast("long"), f)
    return joined.select(
        "_rid", "_key", F.size("starts").cast("long").alias("n_units"), spans("repeated", "starts", "ends", "words").alias("spans"),
    ).select(
        "_rid", "_key", "n_units", total(lambda s, x: s + x["units"]).alias("n_removed"),
        total(lambda s, x: s + x["end"] - x["start"]).alias("removed_chars"), "spans",
    )


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage to remove: key, start and end in the original text (code
    points), n_units and n_words. Texts are read once and not moved."""
    found = _found(docs, key, text, min_words)
    return found.select(F.col("_key").alias(key), F.inline("spans")).select(
        key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.col("units").cast("long").alias("n_units"), F.col("words").cast("long").alias("n_words"),
    )


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, n_units, n_removed, removed_chars and spans (start:end, comma-joined) of each
    row, those without a repeat included."""
    found = _found(docs, key, text, min_words)
    return found.select(
        F.col("_key").alias(key), "n_units", "n_removed", "removed_chars",
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, texts without their repeats. Null texts stay null."""
    rows = written(packed(docs).withColumn("_rid", F.monotonically_increasing_id()), "lines-rows")
    own = rows.select(F.col(f"_row.`{key}`").alias("_key"), F.col(f"_row.`{text}`").alias("_text"), "_rid")
    found = _found(own, "_key", "_text", min_words, "_rid").select("_rid", "spans")

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for body, removed in zip(texts, spans):
            if body is not None:
                at, parts = 0, []
                for s in removed:
                    parts.append(body[at : s["start"]])
                    at = s["end"]
                body = "".join(parts) + body[at:]
            out.append(body)
        return pd.Series(out, dtype=object)

    new = rows.join(found, "_rid").withColumn("_new", cut_out(F.col(f"_row.`{text}`"), F.col("spans")))
    return new.select(*[(F.col("_new") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
