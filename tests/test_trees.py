"""Node tables: exact growth against a plain recursion, cuts of a forest by hand, Spark ML forests read back."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from chemscore.operators import ml
from chemscore.operators import trees as T

FEATURES = ["f0", "f1", "f2"]


def plain_tree(rows, depth_left, weights, min_leaf, node=1, depth=0):
    """rows: (x, label, times) -> {node: (depth, c0, c1, feature, threshold)}"""
    c = [sum(t for _, y, t in rows if y == k) for k in (0, 1)]
    out = {node: (depth, c[0], c[1], None, None)}
    if depth_left and min(c):
        def side(part):
            a, b = (sum(t for _, y, t in part if y == k) * weights[k] for k in (0, 1))
            return a * b / (a + b) if a + b else 0.0
        best = None
        for f in range(3):
            values = sorted({x[f] for x, _, _ in rows})
            for v, w in zip(values, values[1:]):
                left, right = [r for r in rows if r[0][f] <= v], [r for r in rows if r[0][f] > v]
                if min(sum(r[2] for r in left), sum(r[2] for r in right)) >= min_leaf:
                    rest = side(left) + side(right)
                    if best is None or rest < best[0]:
                        best = (rest, f, (v + w) / 2, left, right)
        if best:
            out[node] = (depth, c[0], c[1], best[1], best[2])
            out.update(plain_tree(best[3], depth_left - 1, weights, min_leaf, 2 * node, depth + 1))
            out.update(plain_tree(best[4], depth_left - 1, weights, min_leaf, 2 * node + 1, depth + 1))
    return out


def table(spark, n, seed, values=12):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randrange(values)), float(rnd.randrange(values)), rnd.choice([0.0, -1.5, 2.25]),
             int(rnd.random() < 0.4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, label int")


@pytest.mark.parametrize("weights, min_leaf, bucket_rows", [((1, 1), 1, 200_000), ((3, 2), 1, 40), ((1, 1), 9, 25)])
def test_growth_equals_a_plain_recursion(spark, weights, min_leaf, bucket_rows):
    rows, df = table(spark, 160, 5)
    want = plain_tree([(r[1:4], r[4], 1) for r in rows], 4, weights, min_leaf)
    got = T.grow(df, FEATURES, 4, weights=weights, min_leaf=min_leaf, bucket_rows=bucket_rows).collect()
    assert {r.node: (r.depth, r.c0, r.c1, r.feature, r.threshold) for r in got} == want
    assert all((r.left, r.right) == ((2 * r.node, 2 * r.node + 1) if r.feature is not None else (None, None)) for r in got)
    for r in got:
        a, b = r.c0 * weights[0], r.c1 * weights[1]
        assert r.prob == b / (a + b)


def test_edges_of_growth(spark):
    _, df = table(spark, 30, 1)
    assert T.grow(df.limit(0), FEATURES, 3).collect() == []
    pure = T.grow(df.withColumn("label", F.lit(1)), FEATURES, 3).collect()
    assert [(r.node, r.c0, r.c1, r.feature, r.prob) for r in pure] == [(1, 0, 30, None, 1.0)]
    equal = df.select("id", *[F.lit(1.0).alias(f) for f in FEATURES], "label")           # nothing to split at
    assert len(T.grow(equal, FEATURES, 3).collect()) == 1
    unlabelled = df.withColumn("label", F.when(F.col("id") < 10, F.col("label")))
    assert sum((r.c0 + r.c1) for r in T.grow(unlabelled, FEATURES, 3).where("node = 1").collect()) == 10
    with pytest.raises(Exception, match="null feature f1"):
        T.grow(df.withColumn("f1", F.lit(None).cast("double")), FEATURES, 2).collect()


def test_forest_is_drawn_per_tree(spark):
    _, df = table(spark, 200, 8)
    setting = {"numTrees": 12, "maxDepth": 5, "minInstancesPerNode": 2}
    nodes = ml.exact_forest(df, FEATURES, "id", setting).cache()
    again = ml.exact_forest(df.repartition(5), FEATURES, "id", setting)
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    roots = nodes.where("node = 1").collect()
    sizes = [r.c0 + r.c1 for r in roots]
    assert len(roots) == 12 and len(set(sizes)) > 3 and 150 < sum(sizes) / 12 < 250   # about as many as rows
    assert len({r.feature for r in roots}) > 1                                         # one drawn feature per node
    assert nodes.where("feature is null and c0 + c1 < 2").count() == 0


def walk_by_hand(held, x, depth):
    """Probability of one tree (its nodes by id), cut at ``depth``."""
    r = held[min(held)]
    for _ in range(depth):
        if r.feature is None or np.isnan(r.feature):
            break
        r = held[r.right if x[int(r.feature)] > r.threshold else r.left]
    return r.prob


def test_every_cut_equals_a_forest_cut_by_hand(spark):
    rows, df = table(spark, 150, 3)
    df = df.withColumn("fold", F.col("id") % 3).withColumn("label", F.col("label").cast("double")).cache()
    grid = {"n_estimators": [3, 5, 8], "max_depth": [2, 4, 6], "min_samples_split": [2, 4], "min_samples_leaf": [1, 3]}
    settings = ml.spark_grid(grid)
    nodes = ml.fold_forests(df, FEATURES, [1, 3], 8, 6, "fold", 3, 4)
    got = ml.setting_scores(df, nodes, FEATURES, settings, "fold", "id").collect()
    parts = ml.setting_scores(df, nodes, FEATURES, settings, "fold", "id", limit=120).collect()     # several passes
    assert len(got) == 150 * len(settings) == len(parts)
    held = {}
    for r in nodes.collect():
        held.setdefault((r.forest, r.tree), {})[r.node] = r
    x = {r[0]: r[1:4] for r in rows}
    for r in random.Random(1).sample(got, 400):
        s = settings[r.param_id]
        forest = f"{s['minInstancesPerNode']}:{r.fold}"
        want = np.mean([walk_by_hand(held[forest, t], x[r.id], s["maxDepth"]) for t in range(s["numTrees"])])
        assert abs(want - r.prob) < 1e-12
    key = lambda r: (r.id, r.param_id)
    for a, b in zip(sorted(got, key=key), sorted(parts, key=key), strict=True):
        assert key(a) == key(b) and abs(a.prob - b.prob) < 1e-12
    res = ml.grid_search_cv(df, FEATURES, grid, k=3, id_col="id")
    folds = {(r.param_id, r.fold): r.auc for r in res.folds.collect()}
    assert len(folds) == 3 * len(settings) and res.table.count() == len(settings)
    for p, f in random.Random(2).sample(sorted(folds), 12):
        mine = [r for r in got if r.param_id == p and r.fold == f]
        pairs = [(a.prob > b.prob) + 0.5 * (a.prob == b.prob) for a in mine for b in mine if a.label == 1 and b.label == 0]
        assert abs(folds[p, f] - np.mean(pairs)) < 1e-12
    best = max(res.table.collect(), key=lambda r: (r.mean_auc, -r.param_id))
    assert {k: best[k] for k in res.best_params} == res.best_params


def test_spark_forest_as_a_node_table(spark):
    rows, df = table(spark, 300, 4, values=40)
    df = df.withColumn("label", F.col("label").cast("double"))
    model = Pipeline(stages=[ml.assembler(FEATURES), ml.forest(setting={"numTrees": 15, "maxDepth": 6,
                                                                        "minInstancesPerNode": 1})]).fit(df)
    nodes = T.ml_nodes(spark, model.stages[-1]).cache()
    want = {r.id: r.prob for r in ml.positive_probability(model.transform(df)).collect()}
    for limit in (T.NODES_AT_ONCE, 200):
        got = {r.id: r.prob for r in T.score(df, nodes, FEATURES, ["id"], limit=limit).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    imp = {r.feature: r.importance for r in T.importances(nodes).collect()}
    assert np.allclose([imp.get(i, 0.0) for i in range(3)], model.stages[-1].featureImportances.toArray())


def test_small_tree_as_an_expression(spark):
    _, df = table(spark, 120, 6)
    nodes = ml.balanced_tree(df, FEATURES)
    by_walk = {r.id: r.prob for r in T.score(df, nodes, FEATURES, ["id"]).collect()}
    assert {r.id: r.p for r in df.select("id", T.tree_expression(nodes, FEATURES).alias("p")).collect()} == by_walk
    assert len(set(by_walk.values())) > 3


def test_a_forest_is_fitted_and_scored_in_small_parts(spark):
    """The driver holds few trees of a forest at a time; rows that are alike stay apart."""
    rows, df = table(spark, 120, 5)
    df = df.withColumn("label", F.col("label").cast("double")).cache()
    setting = {"numTrees": 11, "maxDepth": 5, "minInstancesPerNode": 1}
    folders = ml.fit_forest(df, FEATURES, setting, held=60)
    assert len(folders) > 3                                                            # several fits, one forest
    nodes = ml.forest_nodes(spark, folders).cache()
    assert sorted(r.tree for r in nodes.where("node = 0").collect()) == list(range(11))
    assert len({tuple(sorted(str((r.node, r.feature, r.threshold, r.c0, r.c1)) for r in nodes.where(f"tree = {t}").collect()))
                for t in range(11)}) > 5                                               # drawn apart
    twice = df.unionByName(df)
    got = [sorted(map(tuple, T.score(twice, nodes.drop("forest"), FEATURES, ["label"], limit=n).collect())) for n in (T.NODES_AT_ONCE, 60)]
    assert len(got[0]) == len(got[1]) == 240
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(*got, strict=True))


def test_node_tables_stay_off_the_driver(spark, monkeypatch):
    _, df = table(spark, 120, 5)
    nodes = ml.forest_nodes(spark, ml.fit_forest(df.withColumn("label", F.col("label").cast("double")), FEATURES,
                                                 {"numTrees": 6, "maxDepth": 5, "minInstancesPerNode": 1})).drop("forest")
    monkeypatch.setattr(type(nodes), "toPandas", lambda self: pytest.fail("a large node table came to the driver"))
    assert T.score(df, nodes, FEATURES, ["id"], limit=40).count() == 120
