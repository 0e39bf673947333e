"""Classifier evaluation: ROC curve, exact AUC, Youden threshold, accuracy,
confusion counts (E2-E7, E10, P7).

Scores are first collapsed to distinct values per group (partial
aggregation), cumulative counts come from ``ordering.running_totals``, and
the AUC is the exact tie-aware sum
``sum fp_s * (2 * tp_above + tp_s) / (2 P N)`` in DECIMAL(38,0) until the final
division, matching ``roc_auc_score``.  Thresholds are integers compared
exactly: ``tp * N - fp * P`` is ``(tpr - fpr) * P * N``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.operators.joins import lookup_join
from chemscore.operators.ordering import next_values, running_totals
from chemscore.session import materialize

INF = float("inf")


def _with_totals(pts: DataFrame, tot: DataFrame, by: list[str]) -> DataFrame:
    """Attach the class totals P and N: an equi-join on the group keys, or for
    an ungrouped call the two totals as literals (one aggregated row fetched;
    a join on a constant key would be planned as a cartesian product)."""
    if by:
        return lookup_join(pts, tot, by, "inner")
    row = tot.first()
    p = int(row["P"] or 0) if row else 0
    n = int(row["N"] or 0) if row else 0
    return pts.withColumn("P", F.lit(p).cast("long")).withColumn("N", F.lit(n).cast("long"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (),
               times: str | None = None) -> DataFrame:
    """E4 core: one row per (group, distinct score), descending, with the counts
    at that score (``tp_s``, ``fp_s``) and cumulative counts at threshold = score
    (``tp``, ``fp``: rows with score >= threshold)."""
    return _roc_tables(df, score, label, by, times)[0]


def _roc_tables(df: DataFrame, score: str, label: str, by: Sequence[str], times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, class totals); the totals come from the staged distinct-score
    table, not from another pass over the rows."""
    by = list(by)
    y, n = F.col(label).cast("long"), F.col(times).cast("long") if times else F.lit(1)
    q = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y * n).alias("tp_s"), F.sum((F.lit(1) - y) * n).alias("fp_s"))
    # the distinct-score table is read three times below (quantiles, bucket
    # totals, running sums): stage it once instead of re-aggregating the rows
    q = materialize(q, "roc-scores")
    rt = running_totals(q, by, "threshold", ["tp_s", "fp_s"], descending=True)
    pts = rt.select(*by, "threshold", "tp_s", "fp_s", F.col("cum_tp_s").alias("tp"), F.col("cum_fp_s").alias("fp"))
    tot = q.groupBy(*by).agg(F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    return pts, tot


def class_totals(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(*by).agg(F.sum(y).alias("P"), F.sum(F.lit(1) - y).alias("N"))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (),
              drop_intermediate: bool = False) -> DataFrame:
    """(group, threshold, tp, fp, tpr, fpr) for every distinct score plus the
    (+inf, 0, 0) start point; tpr/fpr are NULL when a class is absent.

    ``drop_intermediate`` leaves out what lies on a straight line between its
    neighbours, as scikit-learn does by default: a point but the first and the
    last stays if the step to the next point differs from the step to it."""
    by = list(by)
    pts, tot = _roc_tables(df, score, label, by)
    if drop_intermediate:
        step = ["tp_s", "fp_s"]
        pts = next_values(materialize(pts, "roc-points"), by, "threshold", step, "_next", descending=True)
        first = (F.col("tp") == F.col("tp_s")) & (F.col("fp") == F.col("fp_s"))
        pts = pts.where(first | F.col("_next").isNull() | (F.col("_next") != F.struct(*step)))
    pts = pts.select(*by, "threshold", "tp", "fp")
    if by:
        start = tot.select(*by)
    else:
        start = pts.sparkSession.range(1).select()
    start = start.select(*by, F.lit(INF).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                         F.lit(0).cast("long").alias("fp"))
    j = _with_totals(pts.unionByName(start), tot, by)
    return j.select(*by, "threshold", "tp", "fp",
                    (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
                    (F.col("fp") / F.nullif(F.col("N"), F.lit(0))).alias("fpr"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (),
            times: str | None = None) -> DataFrame:
    """Exact ROC AUC per group (ties count one half); NULL when P or N is 0.
    ``times`` names a column with a row's occurrences."""
    by = list(by)
    pts = roc_points(df, score, label, by, times)
    dec = "decimal(38,0)"
    term = F.col("fp_s").cast(dec) * (F.lit(2).cast(dec) * (F.col("tp") - F.col("tp_s")).cast(dec)
                                      + F.col("tp_s").cast(dec))
    agg = pts.groupBy(*by).agg(F.sum(term).alias("num"), F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    den = F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num").cast("double") / den)
    return agg.select(*by, auc.alias("auc"), F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def youden_threshold(df: DataFrame, score: str = "score", label: str = "label",
                     by: Sequence[str] = ()) -> DataFrame:
    """E5: ``thresholds[argmax(tpr - fpr)]``; the first maximum along the
    descending curve, i.e. the highest threshold among ties; +inf when no
    point beats the origin."""
    by = list(by)
    pts, tot = _roc_tables(df, score, label, by)
    j = _with_totals(pts, tot, by)
    # DECIMAL(38,0): counts of billions would overflow a BIGINT product
    dec = "decimal(19,0)"
    gain = (F.col("tp").cast(dec) * F.col("N").cast(dec) - F.col("fp").cast(dec) * F.col("P").cast(dec)).cast("decimal(38,0)")
    best = j.groupBy(*by).agg(F.max(F.struct(gain.alias("g"), F.col("threshold").alias("t"))).alias("b"))
    # the origin (+inf, 0, 0) has gain 0 and comes first, so it wins unless beaten
    return best.select(*by, F.when(F.col("b.g") > 0, F.col("b.t")).otherwise(F.lit(INF)).alias("threshold"),
                       F.greatest(F.col("b.g"), F.lit(0).cast("decimal(38,0)")).alias("gain"))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score", out: str = "pred") -> DataFrame:
    """``(score >= t)`` as INT."""
    return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def scalar_threshold(df: DataFrame, score: str = "score", label: str = "label") -> float:
    """The global Youden threshold as a Python float (one aggregated value)."""
    row = youden_threshold(df, score, label).first()
    return INF if row is None or row["threshold"] is None else float(row["threshold"])


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col(pred).cast("long") == F.col(label).cast("long")).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Per class: tp, fp, fn, support, precision, recall, F1 (0 when undefined).

    Each (label, pred) cell credits two classes: its label (tp or fn) and its
    prediction (fp when wrong); an ``explode`` of fan-out 2 and one partial
    aggregate, no join."""
    y, p = F.col(label).cast("long"), F.col(pred).cast("long")
    cells = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y") == F.col("p")
    zero = F.lit(0).cast("long")
    credit = F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
                 zero.alias("fp"), F.when(hit, zero).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("p").alias("cls"), zero.alias("tp"),
                 F.when(hit, zero).otherwise(F.col("n")).alias("fp"), zero.alias("fn"))))
    stats = cells.select(credit.alias("c")).groupBy(F.col("c.cls").alias("cls")).agg(
        F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"))
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(F.lit(2.0) * F.col("tp") / F.nullif(F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)),
                    F.lit(0.0))
    return stats.select(F.col("cls").alias("label"), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
                        prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def cv_best(fold_scores: DataFrame, param: str = "param", score: str = "auc") -> DataFrame:
    """Mean score over folds per parameter setting and the best setting;
    ties go to the first in grid order (the smallest ``param``).  Both steps
    are partial aggregates; the per-setting table is as large as the grid."""
    # exact decimal sums: means are compared unrounded, and the order of rows cannot break a tie
    means = fold_scores.groupBy(param).agg(F.avg(F.col(score).cast("decimal(28,18)")).alias("mean_score"))
    # a setting whose folds all lack a class has no mean; it cannot win
    best = F.struct((-F.col("mean_score")).alias("m"), F.col(param).alias("p"))
    return means.filter(F.col("mean_score").isNotNull()).agg(
        F.min_by(F.col(param), best).alias(param),
        F.min_by(F.col("mean_score"), best).cast("double").alias("mean_score"),
        F.count(F.lit(1)).alias("n_settings"))
