"""Exact nearest neighbours in all features by a sampled partition tree.

A tree of median splits over a bounded sample of the vectors gives leaves of
about equal size, whatever the features' scales and densities.  Every vector
goes to its leaf, and two visits answer a query:

1. its own leaf gives candidates and with them a radius that the answer cannot
   exceed;
2. the leaves whose bounding box comes within that radius are looked up by the
   tree (boxes are of the vectors themselves, so empty space is no reason to
   visit), and each gives its own nearest vectors.

Both visits are Spark groups of one leaf and its queries; distances are numpy
blocks.  The sample decides where the borders lie, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.session import materialize

#: Vectors of a leaf, leaves at most (their boxes travel with the tasks), and vectors sampled per leaf.
LEAF_ROWS = 1_024
MAX_LEAVES = 65_536
SAMPLE_PER_LEAF = 16
_CELLS = 1 << 20


class PartitionTree:
    """Median splits; node 0 is the root, a leaf has no children and a number of its own."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._split(sample, leaves)
        self.dim, self.left, self.right, self.leaf = (np.array(x, np.int64) for x in (self.dim, self.left, self.right, self.leaf))
        self.cut = np.array(self.cut, np.float64)

    def _split(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for values, empty in ((self.dim, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            values.append(empty)
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        if leaves < 2 or not spread.max() > 0:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        d = int(np.argmax(spread))
        cut = np.partition(x[:, d], (len(x) - 1) // 2)[(len(x) - 1) // 2]
        if cut == x[:, d].max():                                   # the upper half is one value: it goes right
            cut = x[x[:, d] < cut, d].max()
        low = x[:, d] <= cut
        self.dim[node], self.cut[node] = d, cut
        share = max(1, min(leaves - 1, round(leaves * low.mean())))
        self.left[node] = self._split(x[low], share)
        self.right[node] = self._split(x[~low], leaves - share)
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(inner := rows[self.dim[at[rows]] >= 0]):
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])
            rows = inner
        return self.leaf[at]

    def box(self, low: np.ndarray, high: np.ndarray) -> None:
        """Bounding boxes of all nodes from those of the leaves (an empty leaf has low = inf, high = -inf)."""
        d = low.shape[1]
        self.low, self.high = np.full((len(self.dim), d), np.inf), np.full((len(self.dim), d), -np.inf)
        for node in range(len(self.dim) - 1, -1, -1):              # children come after their parent
            if self.leaf[node] >= 0:
                self.low[node], self.high[node] = low[self.leaf[node]], high[self.leaf[node]]
            else:
                a, b = self.left[node], self.right[node]
                self.low[node] = np.minimum(self.low[a], self.low[b])
                self.high[node] = np.maximum(self.high[a], self.high[b])

    def near(self, x: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs of all leaves whose box is within the query's radius."""
        rows, leaves, stack = [], [], [(0, np.arange(len(x)))]
        while stack:
            node, who = stack.pop()
            if not np.isfinite(self.low[node]).all():
                continue
            gap = np.maximum(0, np.maximum(self.low[node] - x[who], x[who] - self.high[node]))
            # a hair's breadth more, so that rounding cannot hide a tie at the radius
            who = who[(gap * gap).sum(axis=1) * (1 - 1e-12) <= radius2[who]]
            if not len(who):
                continue
            if self.leaf[node] >= 0:
                rows.append(who)
                leaves.append(np.full(len(who), self.leaf[node]))
            else:
                stack += [(self.left[node], who), (self.right[node], who)]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _visit(q: np.ndarray, q_vid: np.ndarray, need: np.ndarray, radius2: np.ndarray, v: np.ndarray, v_vid: np.ndarray,
           weight: np.ndarray) -> list[tuple]:
    """Per query the nearest vectors (itself excluded) within its radius until
    their weights cover its need, ties included: (q_vid, c_vid, weight, dist2, covered)."""
    out = []
    step = max(1, _CELLS // max(1, len(v)))
    for a in range(0, len(q), step):
        block = q[a:a + step]
        dist2 = (block[:, None, 0] - v[None, :, 0]) ** 2
        for f in range(1, v.shape[1]):                             # the order of the sum decides its rounding
            dist2 = dist2 + (block[:, None, f] - v[None, :, f]) ** 2
        dist2[q_vid[a:a + step, None] == v_vid[None, :]] = np.inf
        for i, row in enumerate(dist2, a):
            n = int(need[i])
            first = np.argpartition(row, n - 1)[:n] if n < len(row) else np.arange(len(row))
            first = first[np.lexsort((v_vid[first], row[first]))]
            first = first[np.isfinite(row[first])]
            reached = np.cumsum(weight[first]) >= n
            covered = bool(reached.any())
            cover2 = row[first][np.argmax(reached)] if covered else np.inf
            for c in np.flatnonzero((row <= min(cover2, radius2[i])) & np.isfinite(row)):
                out.append((int(q_vid[i]), int(v_vid[c]), int(weight[c]), float(row[c]), float(cover2) if covered else None))
    return out


_FOUND = "q_vid long, c_vid long, weight long, dist2 double, cover2 double"


def nearest_vectors(queries: DataFrame, vectors: DataFrame, feats: Sequence[str], n_vec: int,
                    leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For each query vector (vid, need, feats) the nearest other distinct
    vectors (vid, weight, feats) until their weights cover ``need``, ties
    included; all others, if they do not suffice: rows (q_vid, c_vid, dist2)."""
    feats = list(feats)
    leaves = max(1, min(MAX_LEAVES, math.ceil(n_vec / leaf_rows)))
    sample = vectors
    if n_vec > 2 * SAMPLE_PER_LEAF * leaves:                       # bounded: about SAMPLE_PER_LEAF * MAX_LEAVES vectors
        share = SAMPLE_PER_LEAF * leaves / n_vec
        sample = vectors.where(F.xxhash64("vid") < F.lit(int(share * 2.0 ** 64) - (1 << 63)))
    held = sample.select(*feats).toPandas().to_numpy(np.float64).reshape(-1, len(feats)) if leaves > 1 else np.empty((0, len(feats)))
    tree = PartitionTree(held, leaves)

    def placed(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf_of(pdf[feats].to_numpy(np.float64)))

    kind = ", ".join(f"{f} double" for f in feats)
    data = materialize(vectors.select("vid", F.col("weight").cast("long").alias("weight"), *feats).mapInPandas(
        placed, f"vid long, weight long, {kind}, leaf long"), "knn-leaves")
    asked = queries.select("vid", F.col("need").cast("long").alias("need"))
    # Explicit partitions: a leaf is few bytes but much work, and must not be merged by bytes.
    deal = max(1, min(tree.leaves, 4 * int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = materialize(data.join(asked, "vid", "left"), "knn-asked")

    def first_visit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, vid, weight = pdf[feats].to_numpy(np.float64), pdf["vid"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        at = np.flatnonzero(pdf["need"].notna())
        rows = _visit(x[at], vid[at], pdf["need"].to_numpy(np.float64)[at], np.full(len(at), np.inf), x, vid, weight)
        return pd.DataFrame(rows, columns=["q_vid", "c_vid", "weight", "dist2", "cover2"]).astype({"cover2": "float64"})

    found = materialize(own.repartition(deal, "leaf").groupBy("leaf").applyInPandas(first_visit, _FOUND), "knn-first-visit")
    if tree.leaves > 1:
        boxes = {r.leaf: r for r in data.groupBy("leaf").agg(                       # one row per leaf
            *[F.min(f).alias(f"lo_{f}") for f in feats], *[F.max(f).alias(f"hi_{f}") for f in feats]).collect()}
        side = lambda name, empty: np.array([[boxes[i][f"{name}_{f}"] if i in boxes else empty for f in feats]
                                             for i in range(tree.leaves)], np.float64)
        tree.box(side("lo", np.inf), side("hi", -np.inf))
        radius = found.groupBy("q_vid").agg(F.min("cover2").alias("radius2")).withColumnRenamed("q_vid", "vid")
        far = own.where("need is not null").join(radius, "vid", "left")

        def further(batches):
            for pdf in batches:
                reach = pdf["radius2"].fillna(np.inf).to_numpy(np.float64)
                rows, leaf = tree.near(pdf[feats].to_numpy(np.float64), reach)
                out = pdf.iloc[rows].assign(radius2=reach[rows], home=pdf["leaf"].to_numpy()[rows], leaf=leaf)
                yield out[out["home"] != out["leaf"]][["vid", "need", "radius2", *feats, "leaf"]]

        visits = far.mapInPandas(further, f"vid long, need long, radius2 double, {kind}, leaf long")
        both = (visits.withColumn("weight", F.lit(None).cast("long"))
                .unionByName(data.select("*", F.lit(None).cast("long").alias("need"), F.lit(None).cast("double").alias("radius2"))))

        def second_visit(pdf: pd.DataFrame) -> pd.DataFrame:
            q, v = pdf[pdf["need"].notna()], pdf[pdf["need"].isna()]
            rows = [] if q.empty or v.empty else _visit(
                q[feats].to_numpy(np.float64), q["vid"].to_numpy(np.int64), q["need"].to_numpy(np.float64),
                q["radius2"].to_numpy(np.float64), v[feats].to_numpy(np.float64), v["vid"].to_numpy(np.int64),
                v["weight"].to_numpy(np.int64))
            return pd.DataFrame(rows, columns=["q_vid", "c_vid", "weight", "dist2", "cover2"]).astype({"cover2": "float64"})

        found = found.unionByName(materialize(
            both.repartition(deal, "leaf").groupBy("leaf").applyInPandas(second_visit, _FOUND), "knn-second-visit"))
    along = Window.partitionBy("q_vid").orderBy("dist2", "c_vid").rowsBetween(Window.unboundedPreceding, 0)
    met = found.withColumn("cum", F.sum("weight").over(along)).join(
        queries.select(F.col("vid").alias("q_vid"), "need"), "q_vid")
    cover = met.withColumn("cover", F.min(F.when(F.col("cum") >= F.col("need"), F.col("dist2"))).over(Window.partitionBy("q_vid")))
    return materialize(cover.where(F.col("cover").isNull() | (F.col("dist2") <= F.col("cover"))).select("q_vid", "c_vid", "dist2"),
                       "knn-nearest")
