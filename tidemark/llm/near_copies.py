"""Near copies by the Jaccard similarity of their sets of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity
of 0.8 or more; a group is what such pairs reach. Equal sets are one class first.

Candidates are compared as in ``simhash``: a set has a fingerprint of 64 bits, and the
fingerprints of a bucket are compared as bit planes with carry-save counters, a run of 64
given up once all of it is beyond the radius. At 0.8 about ten bits differ, so the radius
is ``RADIUS``; no choice of bits of a fingerprint holds so wide a ball in few buckets, so
beside the ten choices of three of five bands there are 32 bands of five minima each
(MinHash). Large buckets are cut into blocks, and each class leaves a block with its
``NEAREST`` nearest in it. Every candidate pair is decided on its whole sets.

Fingerprints decide nothing alone. A pair at exactly 0.8 shares no band of minima with a
probability of 0.000003, a closer pair with less, and in those buckets an exact way takes
what those leave: each class is compared with the least of its bucket, which is one
row a class. Buckets whose other classes are then in one group are done. The rest are dealt into blocks of ``BLOCK`` classes, each
pair of blocks a task of its own; in a block only classes of different groups are
compared, and what leaves it are links that join groups, never all pairs.

A null text is an empty one. Texts without words are copies of one another; shorter
texts than a shingle have all their words as one. Null keys are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words
from tidemark.llm.components import components
from tidemark.llm import simhash
from tidemark.llm.simhash import keep_one, named_classes
from tidemark.session import counted, written

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42

BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(SEED)
_FLIPS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_FACTORS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)

# Bits in which fingerprints of sets at the similarity hardly ever differ more.
RADIUS = 15
NEAREST = 3

# Classes in one block, and shingles that meet the minima in one numpy step.
BLOCK = 256
STEP = 1 << 11


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, sorted."""
    from xxhash import xxh64_intdigest

    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    return np.unique(np.fromiter(
        (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed hash for each band of minima; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[at : at + STEP] ^ _FLIPS) * _FACTORS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of a set's hashes have."""
    step = simhash.STEP
    return simhash.majority(len(hashes), (hashes[at : at + step] for at in range(0, len(hashes), step)))


def _digest(hashes: np.ndarray) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(hashes.tobytes(), SEED)


def _sketch(width: int, text: Column) -> Column:
    @F.pandas_udf("fp string, print long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts]
        return pd.DataFrame({"fp": [_digest(s) for s in sets], "print": [fingerprint(s) for s in sets], "bands": [bands(s) for s in sets]})

    return sketch(text)


def _print(width: int, text: Column) -> Column:
    @F.pandas_udf("string")
    def print_(texts: pd.Series) -> pd.Series:
        return pd.Series([_digest(shingles(t, width)) for t in texts], dtype=object)

    return print_(text)


def _set(width: int, text: Column) -> Column:
    @F.pandas_udf("binary")
    def set_(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts], dtype=object)

    return set_(text)


# --- comparison of fingerprints -------------------------------------------------------


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, fp, print) sorted by bucket: each with the nearest within the radius."""
    kinds = pa.schema([("a", pa.string()), ("b", pa.string())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        keys, prints = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        i, j = simhash.close_pairs(prints, keys, RADIUS)
        i, j = np.r_[i, j], np.r_[j, i]
        order = np.lexsort((np.bitwise_count(prints[i].view(np.uint64) ^ prints[j].view(np.uint64)), i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        names = rows.column(1).combine_chunks()
        near = place < NEAREST
        return pa.RecordBatch.from_arrays([names.take(pa.array(i[near])), names.take(pa.array(j[near]))], schema=kinds)

    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows < simhash.STEP // 4:
            continue
        keys = held.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield solve(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


def close(classes: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """a and b: classes whose fingerprints are close, each with its nearest in every block.

    Blocks of a large bucket do not meet here, so the work is in proportion to the rows.
    """
    banded = classes.where(F.size("bands") > 0).select(
        "fp", "print", F.explode(simhash.band_choices(F.col("print"))).alias("bucket"))
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "copies-choices")
    rows = banded.join(sizes, "bucket").select("bucket", "fp", "print", "n").unionByName(
        shared.select("bucket", "fp", "print", "n"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.ceil(F.col("n") / block).cast("int"))
    dealt = rows.select(F.xxhash64("bucket", own).alias("bucket"), "fp", "print")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_planes, "a string, b string")


# --- comparison of whole sets ---------------------------------------------------------


def _enough(common, a, b, similarity: float):
    """Whether ``common`` of sets of a and b members reach the similarity."""
    return common >= similarity * (a + b - common) - 1e-9


def _alike(similarity: float, left: Column, right: Column) -> Column:
    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for a, b in zip(left, right):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            most = min(len(a), len(b))
            found.append(bool(_enough(most, len(a), len(b), similarity) and _enough(
                len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)))
        return pd.Series(found, dtype=bool)

    return alike(left, right)


def joins(sets: list[np.ndarray], label: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of similar sets that join groups, until no similar pair is left in two groups."""
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    label = np.unique(label, return_inverse=True)[1]
    own = np.zeros(int(codes.max()) + 1, np.int32)
    found = []
    for i in range(len(sets)):
        other = label != label[i]
        if not other.any():
            if (label == label[0]).all():
                break
            continue
        other[: i + 1] = False
        at = np.flatnonzero(other)
        at = at[_enough(np.minimum(sizes[at], sizes[i]), sizes[at], sizes[i], similarity)]
        if not len(at):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        own[mine] = 1
        ends = np.cumsum(sizes[at])
        place = np.arange(int(ends[-1])) + np.repeat(starts[at] - ends + sizes[at], sizes[at])
        common = np.add.reduceat(own[codes[place]], ends - sizes[at])
        own[mine] = 0
        for j in at[_enough(common, sizes[at], sizes[i], similarity)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def _blocks(similarity: float):
    kinds = pa.schema([("a", pa.string()), ("b", pa.string())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names = [r[0] for r in rows]
        pairs = joins([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows]), similarity)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i, _ in pairs], pa.string()), pa.array([names[j] for _, j in pairs], pa.string())],
            schema=kinds)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of rows (bucket, fp, label, members) sorted by bucket."""
        bucket, rows = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if len(rows) > 1:
                        yield solve(rows)
                    bucket, rows = b, []
                rows.append(row)
        if len(rows) > 1:
            yield solve(rows)

    return linked


def links(classes: DataFrame, sets_of, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """a and b: pairs of similar classes that connect all similar classes in a bucket.

    ``classes`` has fp, print and bands; ``sets_of`` gives fp and members for a table of fp.
    """
    banded = classes.select("fp", "print", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    shared = written(banded.join(written(sizes, "copies-buckets"), "bucket"), "copies-shared")
    least = shared.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    pairs = written(
        close(classes, shared, block).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .union(least).distinct(), "copies-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("fp")).union(shared.select("fp"))
    sets = written(sets_of(met.distinct()), "copies-sets")
    members = lambda name: sets.select(F.col("fp").alias(name), F.col("members").alias(f"{name}_members"))
    near = written(
        pairs.join(members("a"), "a").join(members("b"), "b")
        .where(_alike(similarity, F.col("a_members"), F.col("b_members"))).select("a", "b"),
        "copies-near",
    )
    labels = written(components(near).withColumnRenamed("node", "fp"), "copies-labels")
    named = written(
        shared.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "copies-named"
    )
    # All of a bucket have met its least; what may be left are pairs of the others.
    left = counted(
        named.where("fp <> least").groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"),
        "copies-open",
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        named.join(left, "bucket").withColumn("k", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int"))
        .select("fp", "label", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select("fp", "label", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )
    met = (
        dealt.join(sets, "fp").select("bucket", "fp", "label", "members")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_blocks(similarity), "a string, b string")
    )
    return near.union(met)


# --- whole operator -------------------------------------------------------------------


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: that with the smallest key, whole and unchanged."""
    body = F.col(f"`{text}`")
    prints = written(
        docs.select(F.col(f"`{key}`"), _sketch(shingle, body).alias("_s")).select(F.col(f"`{key}`"), "_s.*"),
        "copies-prints",
    )
    own = written(
        prints.groupBy("fp").agg(F.min(f"`{key}`").alias("least"), F.first("print").alias("print"), F.first("bands").alias("bands")),
        "copies-classes",
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Only texts that share a bucket are read again for their sets."""
        # Behind a generator, as in ``keep_one``: the join's null test would take each print again.
        found = docs.select(body.alias("body"), F.explode(F.array(_print(shingle, body))).alias("fp"))
        found = found.join(counted(wanted, "copies-wanted"), "fp").groupBy("fp").agg(F.first("body").alias("body"))
        return found.select("fp", _set(shingle, F.col("body")).alias("members"))

    labels = components(links(own.select("fp", "print", "bands"), sets_of, similarity))
    return keep_one(docs, prints.select(F.col(f"`{key}`"), "fp"), named_classes(own, labels),
                    lambda column: _print(shingle, column), key, text)
