"""ROC/AUC, thresholds, folds, weights: golden values, brute force and properties."""

import random

from pyspark.sql import functions as F

from chemscore.operators import folds as FO
from chemscore.operators import metrics as M
from chemscore.operators.ordering import running_totals


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = 0.0
    for p in pos:
        for n in neg:
            tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def test_golden_roc(spark):
    df = spark.createDataFrame([(1, .9), (0, .8), (1, .8), (0, .1)], "label int, score double")
    pts = [(r.threshold, r.fpr, r.tpr) for r in M.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert pts == [(float("inf"), 0.0, 0.0), (.9, 0.0, .5), (.8, .5, 1.0), (.1, 1.0, 1.0)]
    assert M.roc_auc(df).first().auc == 0.875
    assert M.youden_threshold(df).first().threshold == .9


def test_auc_brute_force_with_ties_and_buckets(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "label int, score double")
    for b in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(b))
        auc = M.roc_auc(df).first().auc
        assert abs(auc - brute_auc(pairs)) < 1e-12
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    neg = df.withColumn("score", -F.col("score"))
    assert abs(M.roc_auc(neg).first().auc - (1 - brute_auc(pairs))) < 1e-12


def test_auc_by_group_and_degenerate(spark):
    df = spark.createDataFrame([("a", 1, .3), ("a", 0, .2), ("b", 1, .5), ("b", 1, .4)], "g string, label int, score double")
    got = {r.g: r.auc for r in M.roc_auc(df, by=["g"]).collect()}
    assert got == {"a": 1.0, "b": None}


def test_running_totals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), i, rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    out = running_totals(df, ["g"], "o", ["v"], buckets=6, row_number="rn").collect()
    for r in out:
        same = [x for x in rows if x[0] == r.g and x[1] <= r.o]
        assert r.cum_v == sum(x[2] for x in same)
        assert r.rn == len(same)


def test_folds_golden_and_balance(spark):
    d = spark.createDataFrame([(i, 0) for i in range(6)] + [(i + 6, 1) for i in range(5)], "id long, label int")
    got = [r.fold for r in FO.stratified_folds(d, k=5).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 3, 4, 0, 1, 2, 3, 4]
    rnd = random.Random(11)
    lab = [(i, rnd.choice([0, 1, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(lab, "id long, label int")
    counts = {}
    for r in FO.stratified_folds(df, k=5).collect():
        counts.setdefault(r.label, {}).setdefault(r.fold, 0)
        counts[r.label][r.fold] += 1
    for per in counts.values():
        assert max(per.values()) - min(per.values()) <= 1


def test_weights_confusion_cast(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0)], "id long, label int")
    w = {r.id: r.weight for r in FO.balanced_weights(df).collect()}
    assert w[3] == 2.0 and abs(w[0] - 4 / 6) < 1e-12
    pr = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, pred int")
    cc = {r.label: r for r in M.confusion_counts(pr).collect()}
    assert (cc[1].tp, cc[1].fn, cc[0].tp, cc[0].fp) == (1, 1, 2, 1)
    t = spark.createDataFrame([("True",), ("0.0",), ("1",), ("x",)], "s string")
    assert [r.v for r in t.select(FO.cast_label("s", strict=False).alias("v")).collect()] == [1, 0, 1, None]
    import pytest
    with pytest.raises(Exception):
        t.select(FO.cast_label("s").alias("v")).collect()


def test_cv_best_ties_go_to_first(spark):
    df = spark.createDataFrame([("p2", .8), ("p1", .8), ("p3", .1)], "param string, auc double")
    assert M.cv_best(df).first().param == "p1"


def test_grouped_roc_curve_and_threshold(spark):
    df = spark.createDataFrame([("a", 1, .9), ("a", 0, .8), ("a", 1, .8), ("a", 0, .1), ("b", 1, .5), ("b", 0, .7)],
                               "g string, label int, score double")
    pts = {}
    for r in M.roc_curve(df, by=["g"]).collect():
        pts.setdefault(r.g, []).append((r.threshold, r.fpr, r.tpr))
    assert sorted(pts["a"], reverse=True) == [(float("inf"), 0.0, 0.0), (.9, 0.0, .5), (.8, .5, 1.0), (.1, 1.0, 1.0)]
    assert sorted(pts["b"], reverse=True) == [(float("inf"), 0.0, 0.0), (.7, 1.0, 0.0), (.5, 1.0, 1.0)]
    th = {r.g: r.threshold for r in M.youden_threshold(df, by=["g"]).collect()}
    assert th == {"a": .9, "b": float("inf")}


def test_cv_best_tells_close_means_apart(spark):
    rows = [("p0", 0.90000000001), ("p0", 0.90000000001), ("p1", 0.90000000002), ("p1", 0.90000000002), ("p2", 0.5), ("p3", None)]
    best = M.cv_best(spark.createDataFrame(rows, "param string, auc double")).first()
    assert (best.param, best.mean_score, best.n_settings) == ("p1", 0.90000000002, 3)
    tie = M.cv_best(spark.createDataFrame([("b", 0.7), ("a", 0.7)], "param string, auc double")).first()
    assert tie.param == "a"


def test_youden_gain_of_billions(spark, monkeypatch):
    from pyspark.sql import functions as F
    counts = [(2.0, 3_500_000_000, 100), (1.0, 500_000_000, 3_999_999_900)]
    pts = spark.createDataFrame([(t, tp, fp) for t, tp, fp in counts], "threshold double, tp_s long, fp_s long")
    cum = spark.createDataFrame([(2.0, 3_500_000_000, 100), (1.0, 4_000_000_000, 4_000_000_000)], "threshold double, tp long, fp long")
    tot = pts.agg(F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"))
    monkeypatch.setattr(M, "_roc_tables", lambda *a: (cum, tot))
    got = M.youden_threshold(pts).first()
    assert got.threshold == 2.0 and int(got.gain) == 3_500_000_000 * 4_000_000_000 - 100 * 4_000_000_000


def test_staged_tables_can_be_dropped(spark):
    import os

    from chemscore import session
    df = session.materialize(spark.range(5), "drop-me")
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    path = "/" + path.lstrip("/")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.drop_staged(spark) >= 1 and not os.path.isdir(path) and session.drop_staged(spark) == 0


def test_lookup_join_measures_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from chemscore.operators import joins
    big = spark.range(100).select((F.col("id") % 3).alias("k"))
    dim = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(joins.lookup_join(big, dim, ["k"]))
    monkeypatch.setattr(joins, "DEFAULT_BROADCAST_BYTES", 2000)
    assert "strategy=broadcast" not in plan(joins.lookup_join(big, dim, ["k"]))
