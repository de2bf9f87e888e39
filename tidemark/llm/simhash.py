"""Near-duplicates by SimHash, compared as bit planes.

A fingerprint has a bit set if more than half of the hashes of the text's three-word
shingles (repeats included) have it set. Documents link if their fingerprints differ
in at most two bits; a group is what links reach.

Equal fingerprints are one class first, so copies never meet each other. Classes are
cut into five bands of bits: two fingerprints within two bits agree on at least three
of them, so comparing inside each of the ten choices of three bands misses no pair.
A bucket beyond ``BLOCK`` classes is dealt into blocks, and every pair of its blocks
is a task of its own, so no bucket is ever gathered whole. Inside a block each run of
64 fingerprints is stored as 64 bit planes, one machine word a plane. A query is
compared with 64 others at once: XOR with its own bit, then two words of carry-save
counters count up to three; a run is abandoned as soon as all its lanes are beyond
the radius. What leaves a block is a star for each group found in it, never its pairs.

A null text is an empty one; texts without words have fingerprint zero and link as any
other. Null keys take part and carry links, but are never a component's smallest key
unless it has no other. Repeated rows come back once each. Empty tables give empty
results. Other columns are ignored by ``groups`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import byte_words, packed
from tidemark.llm.components import components
from tidemark.session import written

SHINGLE = 3
RADIUS = 2
SEED = 42

# Bands of bits, low to high; every RADIUS + 1 of them hold for some close pair.
BANDS = (13, 13, 13, 13, 12)

# Classes in one block; a task of two blocks takes a few megabytes.
BLOCK = 512
# Runs compared in one numpy step.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """Of one text, in pieces of bounded size however long the text is."""
    from xxhash import xxh64_intdigest

    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    return majority(len(starts), (
        np.fromiter(
            (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + STEP], ends[at : at + STEP])),
            np.uint64,
        )
        for at in range(0, len(starts), STEP)))


def majority(number: int, pieces: Iterable[np.ndarray]) -> int:
    """The bits that more than half of ``number`` hashes have, given in pieces, as a signed long."""
    total = np.zeros(64, np.int64)
    for hashes in pieces:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * total > number, bitorder="little")
    return int(set_.view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    return docs.select(*[F.col(f"`{c}`") for c in keep], _fingerprints(F.col(f"`{text}`")).alias("fp"))


# --- comparison in blocks -------------------------------------------------------------


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all prints of one group within the radius; groups are contiguous.

    Each group is padded to whole runs of 64 lanes. A task is one print against one run.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    runs = (sizes + 63) // 64
    first_run = np.cumsum(runs) - runs
    within = np.arange(len(group)) - np.repeat(starts, sizes)
    lane_of = np.repeat(first_run, sizes) * 64 + within
    place = np.full(int(runs.sum()) * 64, -1, np.int64)
    place[lane_of] = np.arange(len(group))
    lanes = np.zeros(len(place), np.uint64)
    lanes[lane_of] = prints.view(np.uint64)
    used = np.packbits((place >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed_bits = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed_bits).view(np.uint64)[:, :, 0]
    found_a, found_b = [], []
    # A print meets the runs from its own on; earlier runs meet it themselves.
    own_run = lane_of // 64
    last_run = np.repeat(first_run + runs, sizes)
    todo = last_run - own_run
    bounds = np.r_[0, np.cumsum(todo)]
    for low in range(0, int(bounds[-1]), STEP):
        task = np.arange(low, min(low + STEP, int(bounds[-1])))
        query = np.searchsorted(bounds, task, side="right") - 1
        run = own_run[query] + (task - bounds[query])
        alive, near = _compare(prints.view(np.uint64)[query], planes, run, used, radius)
        if len(alive):
            lane = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(lane)
            a, b = query[alive[at]], place[run[alive[at]] * 64 + bit]
            later = b > a
            found_a.append(a[later])
            found_b.append(b[later])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a) if found_a else none, np.concatenate(found_b) if found_b else none)


def _compare(query, planes, run, used, radius) -> tuple[np.ndarray, np.ndarray]:
    """Tasks with a lane within the radius, and those lanes as bits of a word."""
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = ~used[run]
    for bit in range(64):
        own = ((query >> np.uint64(bit)) & np.uint64(1)) * np.uint64(0xFFFFFFFFFFFFFFFF)
        carry = planes[bit][run] ^ own
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry | _above(counters, radius)
        if bit % 4 == 3:
            go = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not go.all():
                alive, query, run, over, *counters = (x[go] for x in (alive, query, run, over, *counters))
                if not len(alive):
                    break
    return alive, ~over


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray | np.uint64:
    """Lanes whose count, low bit first, is above the radius; nothing where all bits of that are 1."""
    above, equal = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    if radius & (radius + 1):
        for i in reversed(range(len(counters))):
            if not radius >> i & 1:
                above, equal = above | (equal & counters[i]), equal & ~counters[i]
            else:
                equal = equal & counters[i]
    return above


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of rows (bucket, fp) sorted by bucket; whole buckets are compared at once."""
    held: list[np.ndarray] = []
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = close_pairs(prints, keys)
        label = stars(len(prints), a, b)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[linked]), pa.array(prints[label[linked]])], schema=kinds
        )

    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
        prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False)]
        if len(keys) < STEP // 4:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield solve(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield solve(keys, prints)


def band_choices(fp: Column) -> Column:
    """A hash for each choice of three bands: fingerprints within the radius share one."""
    offsets = np.cumsum((0,) + BANDS[:-1]).tolist()
    masks = [((1 << width) - 1) << at for at, width in zip(offsets, BANDS)]
    keep = len(BANDS) - RADIUS
    choices = []
    for i, chosen in enumerate(combinations(masks, keep)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        choices.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed))))
    return F.array(*choices)


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """a and b: stars over distinct fingerprints ``fp`` that connect all close pairs."""
    banded = classes.select("fp", F.explode(band_choices(F.col("fp"))).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "simhash-buckets")
    shared = banded.join(sizes, "bucket")
    # Rows of a bucket of k blocks go to the k pairs their own block is in.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    dealt = (
        shared.withColumn("k", blocks).withColumn("own", own)
        .select("fp", "bucket", "k", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select(
            F.when(F.col("k") == 1, F.col("bucket"))
            .otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
            .alias("bucket"),
            "fp",
        )
    )
    # Sorted by signed bucket within each task, as searchsorted needs.
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linked, "a long, b long")


# --- whole operator -------------------------------------------------------------------


def classes_of(prints: DataFrame, key: str) -> DataFrame:
    """fp, label and component_id for each distinct fingerprint; a written table.

    The label is the smallest fingerprint of the group, which it has whatever its keys.
    """
    own = written(
        prints.groupBy("fp").agg(F.min(f"`{key}`").alias("least")), "simhash-classes"
    )
    return named_classes(own, components(links(own.select("fp"))))


def named_classes(own: DataFrame, labels: DataFrame) -> DataFrame:
    """Of classes (fp, least) and the labels of the linked ones; a written table."""
    named = own.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    named = written(named, "simhash-labels")
    smallest = written(
        named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-smallest"
    )
    return written(named.join(smallest, "label").select("fp", "label", "component_id"), "simhash-components")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fingerprint`` (16 hex digits) and ``component_id`` for each row."""
    prints = written(with_fingerprint(docs, key, text=text), "simhash-prints")
    return prints.join(classes_of(prints, key), "fp").select(
        F.col(f"`{key}`"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest key, whole and unchanged.

    Only rows of that key leave the join; if rows repeat it, one of them is taken.
    """
    prints = written(with_fingerprint(docs, key, text=text), "simhash-prints")
    return keep_one(docs, prints, classes_of(prints, key), _fingerprints, key, text)


def keep_one(docs: DataFrame, prints: DataFrame, classes: DataFrame, fingerprint_of, key: str, text: str) -> DataFrame:
    """Of each group of ``classes`` the row with the smallest key; ``prints`` has key and fp."""
    groups_ = classes.withColumnsRenamed({"component_id": "_component", "label": "_label"})
    chosen = prints.join(groups_, "fp").where(F.col(f"`{key}`").eqNullSafe(F.col("_component")))
    keeper = written(
        chosen.groupBy("_label").agg(
            F.min("fp").alias("_fp"), F.count("*").alias("_rows"), F.min("_component").alias("_component")
        ),
        "simhash-keepers",
    )
    # The join's null test stops at a generator; pushed below it would fingerprint each text
    # a second time, in Python workers of its own.
    rows = packed(docs).select("_row", F.explode(F.array(fingerprint_of(F.col(f"_row.`{text}`")))).alias("_fp"))
    kept = rows.join(keeper, "_fp").where(F.col(f"_row.`{key}`").eqNullSafe(F.col("_component")))
    single = kept.where("_rows = 1").select("_row")
    if keeper.where("_rows > 1").isEmpty():
        return single.select("_row.*")
    repeated = kept.where("_rows > 1").select(
        "_row", "_label", F.spark_partition_id().alias("_part")
    )
    # One row of each task first, then one of those; a key may be repeated very often.
    for by in (["_label", "_part"], ["_label"]):
        repeated = repeated.dropDuplicates(by)
    return single.union(repeated.select("_row")).select("_row.*")
