"""M4: SMOTE oversampling (Chawla et al., arXiv:1106.1813) as Spark jobs.

1. Minority rows get a dense 0-based index along ``id`` (distributed ranks).
2. Exact k nearest minority neighbours (Euclidean, ties by id, self
   excluded) without comparing all pairs: equal rows are one vector, and
   distinct vectors meet in the leaves of a sampled partition tree over all
   features (``operators.partition_tree``).
3. ``n_new = n_majority - n_minority`` synthetic rows: for draw ``i`` the
   hash ``md5(seed:i)`` picks a (base row, neighbour rank) pair and the gap
   in [0, 1); the row is ``base + gap * (neighbour - base)``.  The hash makes
   the draws reproducible in any engine (the DuckDB oracle uses the same).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.operators.ordering import running_totals
from chemscore.operators.partition_tree import LEAF_ROWS, nearest_vectors
from chemscore.session import materialize


def exact_knn(points: DataFrame, features: Sequence[str], id_col: str = "id", k: int = 5,
              leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, nn_rank 1..k, nn_id, dist2) for every row of ``points``; neighbours
    ordered by (squared distance, id), the row itself excluded.

    Identical rows are collapsed first: a row's duplicates are its nearest
    neighbours (distance 0), and they come from the first k+1 members of its
    vector by id, a bounded fan-out even when one vector holds a third of all
    rows.  Only vectors with at most k copies need other vectors; those are
    found by the partition tree over distinct vectors."""
    feats = list(features)
    pts = points.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in feats])
    vectors = pts.groupBy(*feats).agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("vid"))
    vectors = materialize(vectors, "knn-vectors")
    member = materialize(pts.join(vectors.select(*feats, "vid", "mult"), feats, "inner").select("id", "vid", "mult"),
                         "knn-members")
    ranked = running_totals(member.select("id", "vid"), ["vid"], "id", row_number="r")
    first = materialize(ranked.filter(F.col("r") <= k + 1).select("vid", F.col("id").alias("nn_id"), "r"),
                        "knn-first")

    dup = member.select("id", "vid").join(first, "vid").filter(F.col("nn_id") != F.col("id")) \
        .select("id", "nn_id", F.lit(0.0).alias("dist2"))

    n = vectors.count()
    parts = [dup]
    if n > 1:
        queries = vectors.filter(F.col("mult") <= k).select(
            "vid", (F.lit(k) - (F.col("mult") - F.lit(1))).alias("need"), *feats)
        data = vectors.select("vid", F.least(F.col("mult"), F.lit(k)).alias("weight"), *feats)
        near = nearest_vectors(queries, data, feats, n, leaf_rows)
        # members of the (small) query vectors x members of their near vectors
        qm = member.filter(F.col("mult") <= k).select("id", F.col("vid").alias("q_vid"))
        other = qm.join(near, "q_vid").join(first.filter(F.col("r") <= k).select(F.col("vid").alias("c_vid"), "nn_id"),
                                            "c_vid").select("id", "nn_id", "dist2")
        parts.append(other)
    cand = parts[0]
    for p_ in parts[1:]:
        cand = cand.unionByName(p_)
    w = Window.partitionBy("id").orderBy("dist2", "nn_id")
    return cand.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k) \
        .select("id", "nn_rank", "nn_id", "dist2")


def smote(df: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "doc_id",
          k: int = 5, seed: int = 196) -> DataFrame:
    """Synthetic minority rows ``(i, base_id, nn_id, gap, <features>, label)``."""
    # three labels are enough to see that there are not two
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) != 2:
        raise ValueError("SMOTE here balances a binary label")
    (minority, n_min), (_, n_maj) = sorted(counts.items(), key=lambda kv: (kv[1], kv[0]))
    if n_min <= k:
        raise ValueError(f"SMOTE needs more than k={k} minority rows, got {n_min}")
    n_new = n_maj - n_min
    mino = df.filter(F.col(label) == F.lit(minority)).select(id_col, *features)
    idx = running_totals(mino, [], id_col, row_number="rn").select(
        F.col(id_col).alias("base_id"), (F.col("rn") - 1).alias("base_idx"), *features)
    idx = materialize(idx, "smote-minority")
    knn = exact_knn(mino, features, id_col, k)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")))
    draws = df.sparkSession.range(n_new).select(F.col("id").alias("i")).select(
        "i", F.conv(F.substring(h, 1, 8), 16, 10).cast("long").alias("s"),
        (F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("gap"))
    draws = draws.select("i", "gap", (F.col("s") % F.lit(n_min * k)).alias("s"))
    draws = draws.select("i", "gap", F.floor(F.col("s") / F.lit(k)).alias("base_idx"),
                         (F.col("s") % F.lit(k) + F.lit(1)).alias("nn_rank"))
    base = draws.join(idx, "base_idx", "inner")
    nn = base.join(knn.select(F.col("id").alias("base_id"), "nn_rank", "nn_id"), ["base_id", "nn_rank"], "inner")
    other = idx.select(F.col("base_id").alias("nn_id"), *[F.col(f).alias(f"nn_{f}") for f in features])
    out = nn.join(other, "nn_id", "inner")
    return out.select("i", "base_id", "nn_id", "gap",
                      *[(F.col(f) + F.col("gap") * (F.col(f"nn_{f}") - F.col(f))).alias(f) for f in features],
                      F.lit(minority).cast(df.schema[label].dataType).alias(label))
