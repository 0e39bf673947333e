"""Running sums and row numbers along a global order, without one-partition windows.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row to one task.
Instead the order column is cut into buckets at approximate quantiles (one
aggregation pass; only the ``buckets - 1`` cut points reach the driver), the
per-bucket totals (a table of at most groups x buckets rows) are prefix-summed
into offsets, and the running sums are computed by a window partitioned by
(group, bucket) plus the offset.  Bucket ids are a pure function of the value
(``Bucketizer`` binary search on fixed cut points), so a recomputed task
assigns rows exactly as before; equal values always share a bucket, and a hot
group is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.operators.joins import lookup_join
from chemscore.session import materialize

BUCKET = "_bucket"
# Buckets at most: each is one window task, and the quantile sketch that places
# the cuts is merged towards the driver, so its size must not follow the cluster's
# shuffle partitions.
MAX_BUCKETS = 2048


def quantile_buckets(df: DataFrame, order_col: str, buckets: int | None = None,
                     rel_err: float | None = None) -> DataFrame:
    """Adds ``_bucket`` (0-based, ascending in ``order_col``).  NULL order values
    are not allowed."""
    spark = df.sparkSession
    n = buckets or max(1, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tmp = "_order_d"
    d = df.withColumn(tmp, F.col(order_col).cast("double"))
    cuts: list[float] = []
    if n > 1:
        probs = [i / n for i in range(1, n)]
        cuts = sorted(set(d.approxQuantile(tmp, probs, rel_err if rel_err is not None else 1.0 / (4 * n))))
    splits = [float("-inf")] + [c for c in cuts if c not in (float("-inf"), float("inf"))] + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(BUCKET, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=BUCKET, handleInvalid="keep")
    return b.transform(d).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop(tmp)


def running_totals(df: DataFrame, by: Sequence[str], order_col: str, sums: Sequence[str] = (),
                   descending: bool = False, tiebreak: Sequence[str] = (), buckets: int | None = None,
                   row_number: str | None = None) -> DataFrame:
    """For each column ``s`` in ``sums`` add ``cum_<s>``: the inclusive running
    sum within ``by`` along ``order_col`` (then ``tiebreak``); with
    ``row_number`` also add a 1-based row number within ``by``."""
    by = list(by)
    bucketed = quantile_buckets(df, order_col, buckets)
    totals = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums],
                                              F.count(F.lit(1)).alias("_t_n"))
    border = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    prev = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, BUCKET,
                            *[F.coalesce(F.sum(f"_t_{s}").over(prev), F.lit(0)).alias(f"_o_{s}") for s in sums],
                            F.coalesce(F.sum("_t_n").over(prev), F.lit(0)).alias("_o_n"))
    # staged once (groups x buckets rows at most): its size is then known and the
    # final job does not recompute the totals inside the broadcast
    offsets = materialize(offsets, "bucket-offsets")
    joined = lookup_join(bucketed, offsets, [*by, BUCKET], "inner", stage=False)
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = (Window.partitionBy(*by, BUCKET).orderBy(o, *[F.col(t) for t in tiebreak])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(w) + F.col(f"_o_{s}"))
    if row_number:
        out = out.withColumn(row_number, F.row_number().over(w) + F.col("_o_n"))
    return out.drop(BUCKET, "_o_n", *[f"_o_{s}" for s in sums])


def next_values(df: DataFrame, by: Sequence[str], order_col: str, columns: Sequence[str], out: str = "next",
                descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the row that follows within ``by``
    along ``order_col`` (whose values differ within ``by``), null at the end.

    A row's follower is in its own bucket, or it is the first row of the next
    bucket that has any; only those first rows cross the buckets' borders."""
    by = list(by)
    bucketed = quantile_buckets(df, order_col, buckets)
    here, order = F.struct(*columns), F.col(order_col)
    first = F.max_by(here, order) if descending else F.min_by(here, order)
    along = Window.partitionBy(*by).orderBy(F.col(BUCKET).desc() if descending else F.col(BUCKET).asc())
    borders = bucketed.groupBy(*by, BUCKET).agg(first.alias("_first")).select(
        *by, BUCKET, F.lead("_first").over(along).alias("_beyond"))
    joined = lookup_join(bucketed, materialize(borders, "bucket-borders"), [*by, BUCKET], "inner", stage=False)
    inside = Window.partitionBy(*by, BUCKET).orderBy(order.desc() if descending else order.asc())
    return joined.withColumn(out, F.coalesce(F.lead(here).over(inside), F.col("_beyond"))).drop(BUCKET, "_beyond")
