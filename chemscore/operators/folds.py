"""W3 stratified folds, U1 union of splits, E9 balanced class weights, P4 label cast.

Stratified, unshuffled k-fold in closed form (scikit-learn's layout): number
the classes by first appearance along the row order, lay the rows out sorted
by class, position ``j`` belongs to fold ``j % k``; inside a class the
resulting multiset of folds is handed out in ascending order along row order.
For a class at offset ``s`` with ``c`` rows, fold ``i`` receives
``floor((s+c-1-i)/k) - floor((s-1-i)/k)`` rows, so a row only needs its rank
inside its class (``ordering.running_totals``, no global window) and the tiny
per-class table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.operators.joins import lookup_join
from chemscore.operators.ordering import running_totals


def class_table(df: DataFrame, label: str, order_col: str) -> DataFrame:
    """(label, n_c, offset): classes numbered by first appearance; the table has
    one row per class, so its window is tiny."""
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"), F.min(order_col).alias("_first"))
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return cls.select(label, "n_c", F.coalesce(F.sum("n_c").over(w), F.lit(0)).alias("offset"))


def fold_of(offset: Column, size: Column, rank0: Column, k: int) -> Column:
    """Smallest fold whose cumulative count inside the class exceeds ``rank0``."""
    def cnt(i):
        return (F.floor((offset + size - F.lit(1) - i) / F.lit(k))
                - F.floor((offset - F.lit(1) - i) / F.lit(k)))
    cum = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), i), cnt), F.lit(0).cast("long"),
                                            lambda acc, x: acc + x.cast("long")))
    return F.array_position(F.transform(cum, lambda c: c > rank0), F.lit(True)) - F.lit(1)


def stratified_folds(df: DataFrame, label: str = "label", order_col: str = "id", k: int = 5,
                     out: str = "fold") -> DataFrame:
    """Adds ``fold`` (0..k-1, BIGINT).  Row order is the explicit ``order_col``."""
    ranked = running_totals(df, [label], order_col, row_number="_rn")
    cls = class_table(df, label, order_col)
    j = lookup_join(ranked, cls, [label], "inner")
    return j.withColumn(out, fold_of(F.col("offset"), F.col("n_c"), F.col("_rn") - F.lit(1), k).cast("long")) \
        .drop("_rn", "n_c", "offset")


def concat_splits(**splits: DataFrame) -> DataFrame:
    """``pd.concat`` of same-schema frames, no dedup, with a ``split`` column."""
    out = None
    for name, df in splits.items():
        d = df.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``class_weight='balanced'`` -> n / (k * n_c) for each row."""
    cls = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(0))
    cls = cls.select(label, "n_c", F.sum("n_c").over(w).alias("_n"), F.count(F.lit(1)).over(w).alias("_k"))
    cls = cls.select(label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias(out))
    return lookup_join(df, cls, [label], "left")


def cast_label(c, strict: bool = True) -> Column:
    """``astype(int)`` of a label read as text: booleans (``True``/``False``,
    ``0``/``1``) or numbers (``0.0``/``1.0``).  A value that is neither fails
    the job, as ``astype(int)`` does; ``strict=False`` yields NULL instead."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.coalesce(col.try_cast("boolean").cast("int"), col.try_cast("double").cast("int"))
    if not strict:
        return out
    return F.when(out.isNull(), F.raise_error(F.concat(F.lit("label is not a boolean or a number: "),
                                                       F.coalesce(col.cast("string"), F.lit("NULL"))))
                  ).otherwise(out)
