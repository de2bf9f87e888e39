"""Exact top-k inner products by pivot distances.

Components are taken as floor(scale * x), so scores are exact whole numbers. With M the
largest squared length, a candidate gets one more component, the root of M less its own
squared length, and a query gets zero there; then the squared distance between them is
the query's squared length plus M less twice their inner product, and the best scores
are the nearest neighbours.

Pivots are candidates chosen far from each other out of a bounded sample (``SAMPLE``
rows by hash); every row is then indexed under its nearest pivot by its distance. Each
pivot's rows, sorted by that distance, are cut into annuli of about ``ANNULUS`` rows,
each packed into one row of bytes with its range of distances to every pivot. Queries
are packed alike, by nearest pivot.

The search is in two steps. Each pack of queries first searches the annuli of its own
pivot around its distance, expanding from the nearest until at least k rows are in it;
the k-th score found bounds its k-th distance. By the triangle inequality an annulus can
then hold a better row only if, for every pivot, its range of distances comes within
that bound of the query's; exactly those annuli are searched, and the rest never read.
Bounds leave room for rounding, and scores are compared as integers, so nothing is lost.

Vectors that are null, of another length than most, or hold a null or a value that is
not finite take no part. Ties go to the smaller id; repeated ids are rows of their own,
except that a query never meets rows of its own id. Null ids take no part. Sums must fit in 64 bits. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

K = 10
SCALE = 1024
EVERY = 100

PIVOTS = 32
SAMPLE = 2000
ANNULUS = 2048
QUERIES = 256



def slack(most: float) -> float:
    """Room for rounding: a squared distance is off by some 1e-15 of the largest."""
    return 1e-3 + 1e-6 * float(np.sqrt(most))


def whole_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """_id and _v, whole components as longs, of the rows that take part.

    Rows of another length than the commonest one (ties: the longer) are left out.
    """
    x = F.col("_x")
    rows = table.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_x"))
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.where(F.col("_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = written(
        rows.select("_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("_v")), "topk-vectors"
    )
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("_v") == (common["d"] if common else 0))


def far_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Rows each farthest from those before it."""
    chosen = [0]
    distance = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(vectors)):
        at = int(distance.argmax())
        if distance[at] == 0:
            break
        chosen.append(at)
        distance = np.minimum(distance, ((vectors - vectors[at]) ** 2).sum(axis=1))
    return vectors[chosen]


def lifted(vectors: np.ndarray, most: float | None) -> np.ndarray:
    """Candidates with their further component, or queries (``most`` None) with zero."""
    v = vectors.astype(np.float64)
    more = np.zeros(len(v)) if most is None else np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))
    return np.concatenate([v, more[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def _stacked(lists: pa.Array) -> np.ndarray:
    return np.array(lists.flatten()).reshape(len(lists), -1)


def _keyed(rows: DataFrame, pivots: np.ndarray, most: float | None) -> DataFrame:
    """``_pivot`` and ``_d``: the nearest pivot of each row, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(_stacked(batch.column(1)), most), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                    names=["_id", "_v", "_pivot", "_d"],
                )

    return rows.mapInArrow(run, "_id long, _v array<long>, _pivot int, _d double")


def _packs(rows: DataFrame, size: int, pivots: np.ndarray, most: float | None, purpose: str) -> DataFrame:
    """Rows packed in order of (pivot, distance): pack, n, ids, vectors, low and high.

    The range sort splits a pivot with very many rows over tasks; a pack is cut where the
    pivot changes, where it is full, and at the end of a task.
    """
    ranged = rows.repartitionByRange("_pivot", "_d", "_id").sortWithinPartitions("_pivot", "_d", "_id")

    def pack(ids: np.ndarray, vectors: np.ndarray, pivot: int) -> pa.RecordBatch:
        d = distances(lifted(vectors, most), pivots)
        return pa.RecordBatch.from_arrays(
            [pa.array([pivot], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
             pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
             pa.array([d.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([d.max(axis=0).tolist()], pa.list_(pa.float64()))],
            names=["pivot", "n", "ids", "vectors", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, of = np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _stacked(batch.column(1))
            ids, of = np.r_[ids, np.array(batch.column(0))], np.r_[of, np.array(batch.column(2))]
            vectors = v if vectors is None else np.concatenate([vectors, v])
            while len(ids):
                run_ = int(np.searchsorted(of, of[0], side="right"))
                if run_ == len(ids) and run_ < size:
                    break
                cut = min(run_, size)
                yield pack(ids[:cut], vectors[:cut], int(of[0]))
                ids, vectors, of = ids[cut:], vectors[cut:], of[cut:]
        if len(ids):
            yield pack(ids, vectors, int(of[0]))

    packs = ranged.select("_id", "_v", "_pivot").mapInArrow(
        run, "pivot int, n int, ids binary, vectors binary, low array<double>, high array<double>"
    )
    return written(packs.withColumn("pack", F.monotonically_increasing_id()), purpose)


def _searched(pairs: DataFrame, queries: DataFrame, annuli: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score: the k best of each query in each annulus it is paired with.

    ``pairs`` has the numbers of a query pack (q) and of an annulus (a).
    """
    q = queries.select(F.col("pack").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    a = annuli.select(F.col("pack").alias("a"), "ids", "vectors")
    both = pairs.join(q, "q").join(a, "a").select("q_ids", "q_vectors", "ids", "vectors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_vectors, ids, vectors in batch.itertuples(index=False):
                qi, ci = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                x = np.frombuffer(q_vectors, "<i8").reshape(len(qi), -1)
                y = np.frombuffer(vectors, "<i8").reshape(len(ci), -1)
                yield _best(qi, x, ci, y, k)

    return both.mapInPandas(run, "query_id long, vec_id long, score long")


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors: by floating point where that is exact."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if largest < 2.0**52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _best(qi: np.ndarray, x: np.ndarray, ci: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    scores = exact_products(x, y)
    order = np.argsort(ci, kind="stable")
    scores, ci = scores[:, order], ci[order]
    out_q, out_c, out_s = [], [], []
    for row, q in zip(scores, qi):
        row, own = (row, ci) if not (ci == q).any() else (row[ci != q], ci[ci != q])
        if len(row) > k:
            # All that reach the k-th best score, then the first k of them by id.
            least = np.partition(row, len(row) - k)[len(row) - k]
            pick = np.flatnonzero(row >= least)
            pick = pick[np.argsort(-row[pick], kind="stable")][:k]
        else:
            pick = np.arange(len(row))
        out_q.append(np.full(len(pick), q))
        out_c.append(own[pick])
        out_s.append(row[pick])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": join(out_q), "vec_id": join(out_c), "score": join(out_s)})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, key: str = "vec_id",
          vector: str = "embedding", annulus: int = ANNULUS, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score; queries are ids divisible by ``every``."""
    rows = whole_vectors(table, key, vector, scale)
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    most = float(rows.agg(F.max(F.aggregate("_v", F.lit(0).cast("long"), lambda s, c: s + c * c))).first()[0])
    pivots = far_pivots(lifted(np.array([r[0] for r in sample], np.int64), most), n_pivots)
    annuli = _packs(_keyed(rows, pivots, most), annulus, pivots, most, "topk-annuli")
    queries = _packs(_keyed(rows.where(F.col("_id") % every == 0), pivots, None), QUERIES, pivots, None, "topk-queries")

    first = written(_searched(_nearest(queries, annuli, k), queries, annuli, k), "topk-first")
    bounds = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
        "query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("least"))
    reach = written(_reach(queries, bounds, pivots, most), "topk-reach")
    rest = _searched(_within(reach, annuli, most), queries, annuli, k)
    # Annuli of the first step are searched again, so its rows are not needed twice.
    return _ranked(rest, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(queries: DataFrame, annuli: DataFrame, k: int) -> DataFrame:
    """Each query pack with annuli of its own pivot, from the nearest range outwards,
    until more than k rows beside the queries themselves are certain to be there.

    Repeated ids might all be the query's own; then its bound stays open, and it is
    searched everywhere in the second step.
    """
    own = queries.select(F.col("pack").alias("q"), "pivot", F.expr("(low[pivot] + high[pivot]) / 2").alias("mid"))
    theirs = annuli.select(F.col("pack").alias("a"), "pivot", "n", F.expr("low[pivot]").alias("lo"), F.expr("high[pivot]").alias("hi"))
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("mid"), F.col("mid") - F.col("hi"))
    outward = Window.partitionBy("q").orderBy(gap, "a")
    before = F.coalesce(F.sum("n").over(outward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(theirs, "pivot").withColumn("before", before).where(F.col("before") <= k).select("q", "a")


def _reach(queries: DataFrame, bounds: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """q, low and high: a query pack's distances to each pivot, widened by its queries' bounds.

    The k-th score s found bounds the k-th distance: root of |q|^2 + M - 2 s.
    """
    d = queries.select(F.col("pack").alias("q"), "ids", "vectors")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, ids, vectors in batch.itertuples(index=False):
                qi = np.frombuffer(ids, "<i8")
                x = lifted(np.frombuffer(vectors, "<i8").reshape(len(qi), -1), None)
                yield pd.DataFrame({"q": q, "query_id": qi, "square": (x * x).sum(axis=1), "d": distances(x, pivots).tolist()})

    each = d.mapInPandas(unpack, "q long, query_id long, square double, d array<double>").join(bounds, "query_id", "left")
    radius = F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(
        F.sqrt(F.greatest(F.lit(0.0), F.col("square") + most - 2 * F.col("least"))) + slack(most)
    )
    n = len(pivots)
    low = F.array(*[F.min(F.col("d")[i] - F.col("r")) for i in range(n)])
    high = F.array(*[F.max(F.col("d")[i] + F.col("r")) for i in range(n)])
    return each.withColumn("r", radius).groupBy("q").agg(low.alias("low"), high.alias("high"))


def _within(reach: DataFrame, annuli: DataFrame, most: float) -> DataFrame:
    """Pairs of query pack and annulus whose ranges meet for every pivot.

    Packs are a few hundredths of the rows. Their ranges go to the tasks that hold the
    annuli's in bounded parts, one pass for each part.
    """
    ranges = annuli.select(F.col("pack").alias("a"), "low", "high")
    spark = reach.sparkSession
    room = slack(most)
    found = None
    parts = max(1, -(-reach.count() // PART))
    numbered = written(reach.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))), "topk-parts") if parts > 1 else (
        reach.withColumn("part", F.lit(0)))
    for part in range(parts):
        held = numbered.where(F.col("part") == part).select("q", "low", "high").toPandas()
        numbers = held["q"].to_numpy()
        low = np.array(held["low"].tolist()).reshape(len(held), -1)
        high = np.array(held["high"].tolist()).reshape(len(held), -1)
        shared = spark.sparkContext.broadcast((numbers, low, high))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, low, high = shared.value
            for batch in batches:
                for a, lo, hi in batch.itertuples(index=False):
                    meet = ((low <= np.asarray(hi) + room) & (high >= np.asarray(lo) - room)).all(axis=1)
                    yield pd.DataFrame({"q": q[meet], "a": a})

        pairs = ranges.mapInPandas(run, "q long, a long")
        found = pairs if found is None else found.union(pairs)
    return found


# Query packs whose ranges are held by the driver and sent out at once: with 32 pivots
# some 30 MB.
PART = 50_000


def sql(embeddings: str = "embeddings", k: int = K, scale: int = SCALE, every: int = EVERY) -> str:
    """DuckDB SQL for the rows of :func:`top_k`."""
    return f"""
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows_ q JOIN rows_ x ON q.vec_id % {every} = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= {k}
"""
