"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query in numpy blocks inside Spark
tasks.  A pass gives each query a histogram of its scores over its current
range; summed over all tasks it tells the bin of the query's k-th highest
score, which is the next pass's range, until that value (or a range with few
scores) is known.  A last pass keeps the scores at or above it and breaks ties
by the smaller id.  Scores are integers, so all of it is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from chemscore.llm.common import record_batch, shipped, stage

SCALE = 256
#: Vectors with components beyond this (after scaling) are scored apart, where float64 may not be exact.
LARGEST = 1 << 26
#: Least and highest score: those of a long.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Queries that are broadcast at once; bins of a histogram; candidates scored at once.
CHUNK_QUERIES = 8_192
BINS = 256
BLOCK_ROWS = 256


def _scaled(x: float) -> int:
    """floor(256 * x) of a finite number, exactly."""
    return math.floor(SCALE * x) if abs(x) < 2.0 ** 53 else SCALE * int(x)


def _matrix(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): float64 while that is exact in small sums, else Python integers."""
    v = np.floor(SCALE * x) if np.abs(x).max(initial=0) <= LARGEST / SCALE else None
    if v is not None:
        return v
    return np.array([_scaled(c) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _vectors(batch: pa.RecordBatch):
    """(ids, null ids, integer matrix) of a batch's usable vectors, by dimension and size."""
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    at = column.offsets.to_numpy()[:-1]
    values = column.values
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ok = np.isfinite(x)
    if values.null_count:
        ok &= values.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    usable = (bad[at + sizes] - bad[at] == 0) & column.is_valid().to_numpy(zero_copy_only=False)
    large = np.concatenate([[0], np.cumsum(ok & (np.abs(x) > LARGEST / SCALE))])
    large = large[at + sizes] > large[at]
    ids = batch.column(0)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[usable]):
        for beyond in (False, True):
            rows = np.flatnonzero(usable & (sizes == dim) & (large == beyond))
            for k in range(0, len(rows), BLOCK_ROWS):
                r = rows[k:k + BLOCK_ROWS]
                yield ids[r], none[r], _matrix(x[at[r][:, None] + np.arange(dim)].reshape(len(r), dim))


def _scores(candidates: np.ndarray, queries: np.ndarray):
    """(integer inner products, which of them fit a long), exactly: in float64 while all
    sums stay below 2^53, in longs below 2^63, else in Python integers."""
    largest = int(np.abs(candidates).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, candidates.shape[1])
    if largest < 2 ** 53:
        return (candidates.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64), True
    if largest < 2 ** 63:
        return candidates.astype(np.int64) @ queries.T.astype(np.int64), True
    to_int = np.frompyfunc(int, 1, 1)
    s = np.dot(to_int(candidates).astype(object), to_int(queries.T).astype(object))
    fits = ((s >= LOWEST) & (s <= HIGHEST)).astype(bool)
    return np.where(fits, s, 0).astype(np.int64), fits


class _Chunk:
    """A bounded chunk of queries: ids, matrix by dimension, and each query's range."""

    def __init__(self, rows: list, bins: int = BINS, largest: float = LARGEST / SCALE):
        self.bins = bins
        self.ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        vectors = [np.array(r.embedding, dtype=np.float64) for r in rows]
        kinds = [(len(v), bool(np.abs(v).max(initial=0) > LARGEST / SCALE)) for v in vectors]
        self.by_dim: dict[int, list] = {}
        top = np.zeros(len(rows), dtype=object)
        for dim, beyond in sorted(set(kinds)):
            at = np.array([i for i, kind in enumerate(kinds) if kind == (dim, beyond)])
            q = _matrix(np.array([vectors[i] for i in at]).reshape(len(at), dim))
            self.by_dim.setdefault(dim, []).append((at, q))
            # no score is beyond |q|_1 times the largest component
            top[at] = [int(n) * _scaled(largest) + int(n) + 1 for n in np.abs(q).sum(axis=1)]
        self.low = np.array([max(LOWEST, -t) for t in top], dtype=np.int64)
        self.last = np.array([min(HIGHEST, t) for t in top], dtype=np.int64)  # the range's highest score; higher ones are in above
        self.width = np.array([-(-(min(HIGHEST, t) - max(LOWEST, -t) + 1) // bins) for t in top], dtype=np.uint64)
        self.above = np.zeros(len(rows), dtype=np.int64)
        self.done = np.zeros(len(rows), dtype=bool)

    def blocks(self, batches):
        """(candidate ids, null ids, places of queries, scores, pairs left out) of all pairs of
        blocks: a query's own row, and scores that no long holds."""
        for batch in batches:
            for ids, none, v in _vectors(batch):
                for at, q in self.by_dim.get(v.shape[1], ()):
                    scores, fits = _scores(v, q)
                    yield ids, none, at, scores, (ids[:, None] == self.ids[at]) & ~none[:, None] | ~np.asarray(fits)


_HISTOGRAM = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _histogram(chunk: _Chunk, k: int):
    def run(batches):
        counts = np.zeros((len(chunk.ids), chunk.bins), dtype=np.int64)
        for _, _, at, scores, out in chunk.blocks(batches):
            # As unsigned numbers, distances are right over the whole range of a long.
            bins = ((scores.view(np.uint64) - chunk.low[at].view(np.uint64)) // chunk.width[at]).view(np.int64)
            use = (scores >= chunk.low[at]) & (scores <= chunk.last[at]) & ~out & ~chunk.done[at]
            places = (at * chunk.bins + np.where(use, bins, 0))[use]
            counts += np.bincount(places, minlength=counts.size).reshape(counts.shape)
        # No bin under a task's own k-th score can hold the k-th score of all.
        higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (higher < k))
        yield record_batch(_HISTOGRAM, (q.astype(np.int32), b.astype(np.int32), counts[q, b]))

    return run


def _hits(chunk: _Chunk, k: int):
    def run(batches):
        best: dict[int, list] = {}
        for ids, none, at, scores, out in chunk.blocks(batches):
            r, c = np.nonzero((scores >= chunk.low[at]) & ~out)
            for i, j in zip(r.tolist(), c.tolist(), strict=True):
                best.setdefault(int(at[j]), []).append((-int(scores[i, j]), int(ids[i]), bool(none[i])))
            for q in {int(at[j]) for j in c.tolist()}:
                if len(best[q]) > 4 * k:
                    best[q] = sorted(best[q])[:k]
        rows = [(int(chunk.ids[q]), None if none else i, -s) for q, found in best.items()
                for s, i, none in sorted(found)[:k]]
        yield record_batch(_HITS, list(zip(*rows, strict=True)) if rows else ([], [], []))

    return run


def _refine(candidates: DataFrame, chunk: _Chunk, k: int) -> None:
    """Narrow every query's range down to its k-th score."""
    spark = candidates.sparkSession
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    while not chunk.done.all():
        state = spark.sparkContext.broadcast(chunk)
        hist = (candidates.mapInArrow(lambda it: _histogram(state.value, k)(it), "q int, bin int, n long")
                .groupBy("q", "bin").agg(F.sum("n").alias("n")))
        rows = (hist.withColumn("cum", F.sum("n").over(down))
                .groupBy("q").agg(F.collect_list(F.struct("bin", "n", "cum")).alias("bins")).collect())
        seen = set()
        for r in rows:                                        # bounded: CHUNK_QUERIES rows of at most BINS
            q = r.q
            seen.add(q)
            need = k - int(chunk.above[q])
            hit = next((b for b in sorted(r.bins, key=lambda b: -b.bin) if b.cum >= need), None)
            if hit is None:                                   # fewer than k candidates in all: keep every one
                chunk.done[q] = True
                continue
            width = int(chunk.width[q])
            chunk.low[q] = int(chunk.low[q]) + hit.bin * width
            chunk.last[q] = min(int(chunk.last[q]), int(chunk.low[q]) + width - 1)
            chunk.above[q] += hit.cum - hit.n
            chunk.done[q] = width == 1 or hit.cum <= need + k
            chunk.width[q] = -(-width // chunk.bins)
        for q in range(len(chunk.ids)):
            if q not in seen:
                chunk.done[q] = True


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk_queries: int = CHUNK_QUERIES,
          bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner
    products of every query over all rows of ``vectors`` but its own.

    Both tables hold vec_id and embedding (array of float or double).
    Components become floor(256 * x).  Vectors that are null or hold null or
    non-finite components take no part; vectors of other dimensions do not
    meet, and pairs whose score no long holds do not count.  Ties go to the smaller vec_id (null ids last).  A row with the
    query's id is its own.  Repeated candidate rows are candidates each;
    repeated query rows are one query; queries need an id.  Other columns are
    ignored; empty tables give no rows.  Queries are broadcast in chunks of
    about ``chunk_queries``, chosen by a hash of the id.
    """
    x = F.col("embedding")
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    asked = "array<float>" if queries.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    candidates = shipped(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(kind).alias("embedding"))
    queries = stage(queries.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(asked).alias("embedding"))
                    .where(usable & F.col("vec_id").isNotNull()).distinct(), "topk-queries")
    # The candidates' largest component bounds all scores, so the passes start from a narrow range.
    largest = candidates.where(usable).agg(F.max(F.array_max(F.transform(x, lambda c: F.abs(c.cast("double")))))).first()[0]
    n = queries.count()
    chunks, found = max(1, -(-n // chunk_queries)), []
    for c in range(chunks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()
        if not rows:
            continue
        chunk = _Chunk(rows, bins, largest or 0.0)
        _refine(candidates, chunk, k)
        state = vectors.sparkSession.sparkContext.broadcast(chunk)
        found.append(stage(candidates.mapInArrow(lambda it, s=state: _hits(s.value, k)(it),
                                                 "query_id long, vec_id long, score long"), "topk-hits"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
