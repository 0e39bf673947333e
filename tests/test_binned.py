"""Binned forests: growth against a plain recursion, cells against plain counts, and the grid search on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chemscore.operators import binned as B
from chemscore.operators import metrics as M
from chemscore.operators import ml
from chemscore.operators import trees as T

FEATURES = ["a", "b", "c"]


def rows_of(n, seed, folds=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.gauss(0, 1), float(rnd.randrange(5))
        out.append((i, a, b, rnd.choice([0.0, 0.0, 0.0, 2.5]), float(rnd.random() < 1 / (1 + np.exp(-2 * a - b + 2))), i % folds))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double, fold long")


def plain(bins, weights, cells, depth, leaf):
    """[(depth left, c0, c1, feature, bin)] from the root, left side first."""
    c = weights[:, cells].sum(axis=1)
    here, best = (depth, *c, -1, -1), None
    if depth and min(c):
        for f in range(len(bins)):
            for b in sorted(set(bins[f, cells]))[:-1]:
                sides = [cells[bins[f, cells] <= b], cells[bins[f, cells] > b]]
                le, ri = (weights[:, s].sum(axis=1) for s in sides)
                if min(le.sum(), ri.sum()) >= leaf:
                    gain = 2 * (le[0] * ri[1] - le[1] * ri[0]) ** 2 / (c.sum() * le.sum() * ri.sum())
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, sides)
    if not best:
        return [here]
    return [(*here[:3], best[1], best[2]), *plain(bins, weights, best[3][0], depth - 1, leaf), *plain(bins, weights, best[3][1], depth - 1, leaf)]


def test_growth_against_a_plain_recursion():
    rng = np.random.default_rng(3)
    for _ in range(150):
        bins = np.unique(rng.integers(0, rng.integers(2, 9), (3, rng.integers(1, 60))), axis=1).astype(np.uint8)
        weights = rng.poisson(rng.choice([0.5, 1, 3]), (2, bins.shape[1])).astype(float)
        leaf, depth = int(rng.integers(1, 4)), int(rng.integers(0, 8))
        cells = B.Cells(0, [], bins, weights, weights)
        tree, cut = B.grow(cells, weights, depth, leaf, 3, rng, range(depth + 1))
        mine = []

        def walk(i, left):
            mine.append((left, *tree.counts[:, i], tree.feature[i], tree.bin[i]))
            if tree.left[i] >= 0:
                walk(tree.left[i], left - 1)
                walk(tree.left[i] + 1, left - 1)
        walk(0, depth)
        assert mine == plain(bins, weights, np.arange(bins.shape[1]), depth, leaf)
        for d in range(depth + 1):                                      # cells without weight go down too
            for c in range(bins.shape[1]):
                i = 0
                for _ in range(d):
                    if tree.left[i] >= 0:
                        i = tree.left[i] + (bins[tree.feature[i], c] > tree.bin[i])
                assert cut[d][c] == tree.prob[i]
        shallow, _ = B.grow(cells, weights, depth // 2, leaf, 2, np.random.default_rng(1))
        deep, _ = B.grow(cells, weights, depth, leaf, 2, np.random.default_rng(1))
        assert (deep.feature[:len(shallow.left)][shallow.left >= 0] == shallow.feature[shallow.left >= 0]).all()


def test_cells_are_counted_per_training_set(spark):
    rows = rows_of(400, 1)
    rows[0] = (0, 1e9, *rows[0][2:])                                    # in fold 0
    rows[7] = (*rows[7][:5], None)
    sets = B.binned(frame(spark, rows), FEATURES, "fold", [0, 1, None])
    for s in sets:
        seen = [r for r in rows if s.out is None or (r[5] is not None and r[5] != s.out)]
        held = [r for r in rows if s.out is not None and r[5] == s.out]
        x = np.array([r[1:4] for r in seen])
        assert len(s.edges[0]) <= 63 and list(s.edges[1]) == [0.5, 1.5, 2.5, 3.5] and list(s.edges[2]) == [1.25]
        assert max(np.bincount(np.searchsorted(s.edges[0], x[:, 0]))) <= 3 * len(seen) / 64 and not set(s.edges[0]) & set(x[:, 0])
        assert max(s.edges[0]) < 100                                    # the bins of a set know its own rows only
        for part, got in ((seen, s.seen), (held, s.held)):
            want = {}
            for r in part:
                cell = tuple(int(np.searchsorted(e, v)) for e, v in zip(s.edges, r[1:4]))
                want.setdefault(cell, [0, 0])[int(r[4])] += 1
            assert {tuple(map(int, b)): list(c) for b, c in zip(s.bins.T, got.T) if c.any()} == want
    assert B.binned(frame(spark, rows), FEATURES, "fold", [0], limit=5) is None
    for bad, text in (("a", "null feature a"), ("label", "label is neither")):
        with pytest.raises(Exception, match=text):
            B.binned(frame(spark, rows).withColumn(bad, F.when(F.col("id") > 3, F.col(bad))), FEATURES, "fold", [0])
    with pytest.raises(ValueError, match="outside fold 1"):
        B.binned(frame(spark, rows).where("fold = 1"), FEATURES, "fold", [1])


def test_grid_search_and_flow_grow_forests_in_tasks(spark, monkeypatch):
    rows = rows_of(600, 2)
    df = frame(spark, rows).withColumn("split", F.expr("CASE id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END")).cache()
    grid = {"n_estimators": [10, 25], "max_depth": [3, 6], "min_samples_leaf": [1, 4]}
    by_spark = ml.grid_search_cv(df, FEATURES, grid, k=3, id_col="id", limit=0)
    monkeypatch.setattr(ml, "fit_forest", lambda *a, **k: pytest.fail("a forest was fitted by the driver"))
    res = ml.grid_search_cv(df, FEATURES, grid, k=3, id_col="id")
    assert res.folds.count() == by_spark.folds.count() == 24
    for r in res.folds.groupBy("fold").agg(F.max("n_pos").alias("p"), F.max("n_neg").alias("n"), F.min("n_pos").alias("p0")).collect():
        mine = [x for x in rows if x[5] == r.fold]
        assert (r.p, r.n, r.p0) == (sum(x[4] == 1 for x in mine), sum(x[4] == 0 for x in mine), r.p)
    auc = [{r.param_id: r.mean_auc for r in g.table.collect()} for g in (res, by_spark)]
    assert auc[0].keys() == auc[1].keys() and all(abs(auc[0][p] - auc[1][p]) < 0.05 for p in auc[0])
    roots = res.nodes.where("node = 0").collect()                       # a refit on all rows
    assert len(roots) == res.best_params["numTrees"] and abs(sum(r.c0 + r.c1 for r in roots) / len(roots) - 600) < 30
    assert len({(r.feature, r.threshold) for r in roots}) > 5
    small = res.nodes.where("feature is null").agg(F.min(F.col("c0") + F.col("c1"))).first()[0]
    assert small >= res.best_params["minInstancesPerNode"]
    again = ml.grid_search_cv(df.repartition(7), FEATURES, grid, k=3, id_col="id")
    assert sorted(map(tuple, again.folds.collect())) == sorted(map(tuple, res.folds.collect()))
    flow = ml.tune_and_apply(df, FEATURES, grid, k=3, threshold_on="oof", id_col="id")
    got = {(r.split, r.metric): r.value for r in flow.metrics.collect()}
    assert 0.6 < got["test", "auc"] <= 1.0 and flow.scored.count() == 600


def test_auc_of_counted_rows(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), rnd.randrange(6) / 4, rnd.randrange(2), rnd.randrange(4)) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, score double, label int, times long")
    each = df.where("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(M.roc_auc(df, by=["g"], times="times")) == key(M.roc_auc(each, by=["g"]))


def test_scores_are_the_same_by_walking_the_nodes(spark):
    """Refit nodes hold thresholds: rows walk them as cells walk bins."""
    df = frame(spark, rows_of(300, 6))
    cells = B.binned(df, FEATURES, "fold", [1])
    nodes = B.node_tables(spark, [("2:1", cells[0], 2)], 25, 6, 11).cache()
    sums = {(r.h0, r.h1, round(r.sums[0], 9)) for r in B.cut_sums(spark, cells, [2], [25], [6], 11).collect()}
    left_out = T.score(df.where("fold = 1"), nodes.drop("forest"), FEATURES, FEATURES + ["label"]).collect()
    edges, found = cells[0].edges, {}
    for r in left_out:
        cell = tuple(int(np.searchsorted(e, r[f])) for e, f in zip(edges, FEATURES))
        found.setdefault(cell, [0, 0, round(r.prob * 25, 9)])[int(r.label)] += 1
        assert found[cell][2] == round(r.prob * 25, 9)
    assert {tuple(v) for v in found.values()} == sums
