"""Exact k-NN (partition tree) against brute force; SMOTE invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chemscore.operators.partition_tree import PartitionTree
from chemscore.operators.smote import exact_knn, smote


def brute(points, k):
    out = {}
    for pid, *x in points:
        d = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), qid) for qid, *y in points if qid != pid)
        out[pid] = [q for _, q in d[:k]]
    return out


@pytest.mark.parametrize("leaf_rows", [1_024, 16])
def test_knn_matches_brute_force_with_clusters_and_ties(spark, leaf_rows):
    rnd = random.Random(5)
    pts = [(i, float(rnd.randint(0, 1000)), float(rnd.randint(0, 50)), float(rnd.randint(0, 3))) for i in range(150)]
    pts += [(1000 + i, 500.0 + rnd.random(), 20.0, 1.0) for i in range(40)]   # a dense cluster
    pts += [(2000 + i, 7.0, 7.0, 7.0) for i in range(4)]                        # a few exact duplicates
    pts += [(3000 + i, 300.0, 10.0, 2.0) for i in range(12)]                    # a hot duplicate vector
    df = spark.createDataFrame(pts, "id long, a double, b double, c double")
    got = {}
    for r in exact_knn(df, ["a", "b", "c"], "id", 5, leaf_rows).collect():
        got.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
    want = brute(pts, 5)
    assert set(got) == set(want)
    for pid, lst in got.items():
        assert [q for _, q in sorted(lst)] == want[pid], pid


def test_knn_in_six_features_and_few_rows(spark):
    rnd = random.Random(2)
    names = ["a", "b", "c", "d", "e", "f"]
    types = "id long, " + ", ".join(f"{n} double" for n in names)
    # one wide feature, steep clusters in the others, values with many ties
    pts = [(i, rnd.uniform(0, 1e5) if i % 3 else 50.0, *(float(rnd.choice([0, 0, 1, 5, 40])) for _ in range(5))) for i in range(260)]
    for rows, leaf_rows in ((pts, 20), (pts[:3], 16), (pts[:1], 16)):
        got = {}
        for r in exact_knn(spark.createDataFrame(rows, types), names, "id", 5, leaf_rows).collect():
            got.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
        want = brute(rows, 5)
        assert {p: [q for _, q in sorted(lst)] for p, lst in got.items()} == {p: q for p, q in want.items() if q}


def test_tree_leaves_and_lookups():
    rnd = np.random.default_rng(6)
    x = np.concatenate((rnd.normal(size=(3_000, 4)), np.repeat(rnd.normal(size=(1, 4)), 500, axis=0) + [[0, 0, 0, 1e-9]]))
    tree = PartitionTree(x, 40)
    leaf = tree.leaf_of(x)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert tree.leaves > 20 and sizes.max() < 700
    low = np.array([x[leaf == i].min(axis=0) if (leaf == i).any() else np.full(4, np.inf) for i in range(tree.leaves)])
    high = np.array([x[leaf == i].max(axis=0) if (leaf == i).any() else np.full(4, -np.inf) for i in range(tree.leaves)])
    tree.box(low, high)
    q, radius2 = rnd.normal(size=(50, 4)), rnd.uniform(0, 1, 50)
    rows, leaves = tree.near(q, radius2)
    met = set(zip(rows.tolist(), leaves.tolist()))
    for i in range(50):
        inside = {int(j) for j in leaf[((x - q[i]) ** 2).sum(axis=1) <= radius2[i]]}
        assert inside <= {b for a, b in met if a == i}
    assert len(met) < 50 * tree.leaves


def test_smote_balances_and_interpolates(spark):
    rnd = random.Random(9)
    rows = [(i, 1 if i % 4 else 0, float(rnd.randint(0, 100)), float(rnd.randint(0, 10))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, label long, x double, y double")
    out = smote(df, ["x", "y"], "label", "doc_id", k=5).collect()
    assert len(out) == 90 - 30
    byid = {r[0]: r for r in rows}
    for r in out:
        b, n = byid[r.base_id], byid[r.nn_id]
        assert 0.0 <= r.gap < 1.0 and b[1] == 0 and n[1] == 0
        assert abs(r.x - (b[2] + r.gap * (n[2] - b[2]))) < 1e-9
