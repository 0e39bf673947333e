"""Decision trees and forests as node tables: exact growth, scoring, importances.

A node table has one row per node: ``tree, node, depth, c0, c1`` (class counts),
``feature, threshold, gain`` (null at leaves), ``left, right`` (node ids, null at
leaves) and ``prob`` (share of class 1).  It is what ``grow`` builds and what a
fitted Spark ML forest is read into, so both are scored, cut and weighed by the
same code.

Growth is level-wise over all trees at once and considers every distinct value
of every feature, without binning.  Class counts per (tree, node, feature,
value) are a partial aggregate; their running sums along the values are taken
in buckets of values (cut once at approximate quantiles) on top of the buckets'
own prefix sums, so that no task sorts a whole node.  A split's two sides are
weighed in integers and compared as doubles of one fixed formula; ties go to the
lower feature, then the lower value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.operators.joins import lookup_join
from chemscore.session import materialize, staged_path

#: Distinct values of a feature that one window task sorts, at most about.
BUCKET_ROWS = 200_000
MAX_BUCKETS = 2048
NODES = ("tree INT, node BIGINT, c0 DOUBLE, c1 DOUBLE, feature INT, threshold DOUBLE, gain DOUBLE, left BIGINT, "
         "right BIGINT, prob DOUBLE")
#: Nodes that travel with scoring tasks by way of the driver, and that one task of
#: a larger table meets; rows that such a task scores.
NODES_AT_ONCE = 250_000
BLOCK_ROWS = 200_000
_SCORE_ROWS = 2_000


# ----- drawing --------------------------------------------------------------------------------

def draw(*parts) -> Column:
    """A draw in [0, 2^32) from the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def poisson_cuts(limit: int = 12) -> list[int]:
    """Upper ends (of 2^32) of 0, 1, 2, ... occurrences under the Poisson law of mean 1."""
    return [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(limit)]


def bootstrap(rows: DataFrame, trees: int, id_col: str, seed: int) -> DataFrame:
    """Each row once per tree that draws it, with ``times`` (Poisson bootstrap;
    a draw depends on seed, tree and row id only)."""
    drawn = draw(seed, F.col("tree"), F.col(id_col))
    times = sum((drawn >= c).cast("int") for c in poisson_cuts())
    return (rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("times", times)
            .where("times > 0"))


# ----- growth -----------------------------------------------------------------------------------

def _weighed(c0: Column, c1: Column, weights: tuple[int, int]) -> Column:
    """Weighted size times half the Gini impurity."""
    a, b = c0.cast("double") * F.lit(float(weights[0])), c1.cast("double") * F.lit(float(weights[1]))
    return F.when(a + b > 0, a * b / (a + b)).otherwise(F.lit(0.0))


def _bucketed(rows: DataFrame, features: Sequence[str], bucket_rows: int) -> tuple[DataFrame, int]:
    """``x``: per feature (value, bucket), and how many buckets there are; they are cut once, at approximate quantiles."""
    buckets = max(1, min(MAX_BUCKETS, -(-rows.count() // bucket_rows)))
    doubles = rows.select("*", *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    names = [f"_v{i}" for i in range(len(features))]
    cuts = doubles.approxQuantile(names, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else None
    for i, n in enumerate(names):
        splits = sorted(set(cuts[i])) if cuts else []
        if splits:
            doubles = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=n, outputCol=f"_b{i}").transform(doubles)
        else:
            doubles = doubles.withColumn(f"_b{i}", F.lit(0.0))
    x = F.array(*[F.struct(F.col(f"_v{i}").alias("value"), F.col(f"_b{i}").cast("int").alias("bucket"))
                  for i in range(len(names))])
    return doubles.withColumn("x", x).drop(*names, *[f"_b{i}" for i in range(len(names))]), buckets


def _running(cells: DataFrame, buckets: int) -> DataFrame:
    """Along each feature's values in a node: l0, l1 (counts up to the value), n0, n1 (of the node) and the next value."""
    key = ["tree", "node", "feature"]
    up = Window.partitionBy(*key, "bucket").orderBy("value")
    run = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if buckets == 1:
        whole = Window.partitionBy(*key, "bucket")
        return cells.select(*key, "value", F.sum("c0").over(whole).alias("n0"), F.sum("c1").over(whole).alias("n1"),
                            F.sum("c0").over(run).alias("l0"), F.sum("c1").over(run).alias("l1"),
                            F.lead("value").over(up).alias("next")).where("n0 > 0 and n1 > 0")
    cells = materialize(cells, "tree-cells")
    order = Window.partitionBy(*key).orderBy("bucket")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    zero = F.lit(0).cast("long")
    borders = materialize(
        cells.groupBy(*key, "bucket").agg(F.sum("c0").alias("b0"), F.sum("c1").alias("b1"), F.min("value").alias("first"))
        .select(*key, "bucket", F.coalesce(F.sum("b0").over(before), zero).alias("o0"),
                F.coalesce(F.sum("b1").over(before), zero).alias("o1"), F.sum("b0").over(whole).alias("n0"),
                F.sum("b1").over(whole).alias("n1"), F.lead("first").over(order).alias("beyond"))
        .where("n0 > 0 and n1 > 0"), "tree-borders")
    return lookup_join(cells, borders, [*key, "bucket"], "inner", stage=False).select(
        *key, "value", "n0", "n1", (F.sum("c0").over(run) + F.col("o0")).alias("l0"),
        (F.sum("c1").over(run) + F.col("o1")).alias("l1"), F.coalesce(F.lead("value").over(up), F.col("beyond")).alias("next"))


def _best_splits(rows: DataFrame, buckets: int, weights: tuple[int, int], min_leaf: int, per_node: int | None,
                 seed: int) -> DataFrame:
    """(tree, node, feature, threshold, gain) of the nodes that can be split."""
    key = ["tree", "node", "feature"]
    cells = (rows.select("tree", "node", F.posexplode("x").alias("feature", "cell"), "c0", "c1")
             .groupBy(*key, F.col("cell.bucket").alias("bucket"), F.col("cell.value").alias("value"))
             .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    points = _running(cells, buckets)
    r0, r1 = F.col("n0") - F.col("l0"), F.col("n1") - F.col("l1")
    points = points.where(F.col("next").isNotNull() & (F.col("l0") + F.col("l1") >= min_leaf) & (r0 + r1 >= min_leaf))
    sides = _weighed(F.col("l0"), F.col("l1"), weights) + _weighed(r0, r1, weights)
    best = points.groupBy(*key).agg(
        F.max(F.struct((-sides).alias("rest"), (-F.col("value")).alias("low"), "value", "next", "n0", "n1")).alias("s"))
    if per_node:                                # the first so many features in drawn order that can split the node
        drawn = Window.partitionBy("tree", "node").orderBy(draw(seed, F.col("tree"), F.col("node"), F.col("feature")), "feature")
        best = best.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= per_node)
    best = best.groupBy("tree", "node").agg(
        F.max(F.struct(F.col("s.rest").alias("rest"), (-F.col("feature")).alias("first"), "s")).alias("b"))
    middle = (F.col("b.s.value") + F.col("b.s.next")) / 2
    return best.select(
        "tree", "node", (-F.col("b.first")).alias("feature"),
        F.when(middle < F.col("b.s.next"), middle).otherwise(F.col("b.s.value")).alias("threshold"),
        (_weighed(F.col("b.s.n0"), F.col("b.s.n1"), weights) + F.col("b.rest")).alias("gain"))


def grow(rows: DataFrame, features: Sequence[str], max_depth: int, label: str = "label", weights: tuple[int, int] = (1, 1),
         min_leaf: int = 1, per_node: int | None = None, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The node table of the trees over ``rows`` (optional columns ``tree`` and
    ``times``, a row's occurrences), classes weighted by the integers ``weights``.

    A node is split while it is impure, above ``max_depth`` and has two values
    with ``min_leaf`` rows on each side, as scikit-learn's best splitter does.
    Rows with a null feature fail the job; rows without a label are left out.
    """
    for column, default in (("tree", 0), ("times", 1)):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(default))
    y = F.col(label).cast("int")
    rows = rows.where(y.isNotNull()).select(
        F.col("tree").cast("int").alias("tree"), (F.col("times") * (1 - y)).cast("long").alias("c0"),
        (F.col("times") * y).cast("long").alias("c1"),
        *[F.coalesce(F.col(f).cast("double"), F.raise_error(F.lit(f"null feature {f}")).cast("double")).alias(f) for f in features])
    rows, buckets = _bucketed(materialize(rows, "tree-input"), features, bucket_rows)
    state = materialize(rows.select("tree", F.lit(1).cast("long").alias("node"), "c0", "c1", "x"), "tree-rows")
    out = None
    for depth in range(max_depth + 1):
        totals = state.groupBy("tree", "node").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        splits = None
        if depth < max_depth:
            splits = materialize(_best_splits(state, buckets, weights, min_leaf, per_node, seed), "tree-splits")
            level = totals.join(splits, ["tree", "node"], "left")
        else:
            level = totals.select("*", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"),
                                  F.lit(None).cast("double").alias("gain"))
        split = F.col("feature").isNotNull()
        a, b = F.col("c0") * weights[0], F.col("c1") * weights[1]
        level = materialize(level.select(
            "tree", "node", F.lit(depth).alias("depth"), "c0", "c1", F.col("feature").cast("int").alias("feature"), "threshold",
            "gain", F.when(split, F.col("node") * 2).alias("left"), F.when(split, F.col("node") * 2 + 1).alias("right"),
            (b.cast("double") / (a + b).cast("double")).alias("prob")), "tree-level")
        out = level if out is None else out.unionByName(level)
        if splits is None or not splits.limit(1).count():
            break
        goes = (F.get(F.col("x"), F.col("feature"))["value"] > F.col("threshold")).cast("long")
        state = materialize(lookup_join(state, splits.select("tree", "node", "feature", "threshold"), ["tree", "node"], "inner",
                                        stage=False)
                            .select("tree", (F.col("node") * 2 + goes).alias("node"), "c0", "c1", "x"), "tree-rows")
    return out


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): each tree's gains per feature, as shares of the
    tree's own sum; their mean over the trees, scaled to a sum of one.  Trees
    without a split add nothing."""
    per = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    trees = per.groupBy("tree").agg(F.sum("g").alias("t")).where("t > 0")
    shares = per.join(trees, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    total = Window.partitionBy(F.lit(0))                             # one row per feature
    return shares.select("feature", (F.col("s") / F.sum("s").over(total)).alias("importance"))


# ----- Spark ML forests as node tables --------------------------------------------------------------

def ml_nodes(spark: SparkSession, model) -> DataFrame:
    """The node table of a fitted Spark ML tree or forest of two classes, read
    from its saved form.  Gains are weighted by their node's size."""
    path = staged_path(spark, "ml-forest")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    c0, c1 = (F.get("impurityStats", F.lit(i)) for i in (0, 1))
    of = lambda c: F.when(inner, c)
    return data.select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("long").alias("node"), c0.alias("c0"), c1.alias("c1"),
        of(F.col("split.featureIndex")).cast("int").alias("feature"),
        of(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), of(F.col("gain") * (c0 + c1)).alias("gain"),
        of(F.col("leftChild")).cast("long").alias("left"), of(F.col("rightChild")).cast("long").alias("right"),
        (c1 / (c0 + c1)).alias("prob"))


# ----- scoring --------------------------------------------------------------------------------------

@dataclass
class Forest:
    """Node arrays of some trees; a leaf's children are itself."""
    roots: np.ndarray
    trees: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prob: np.ndarray

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> Forest:
        nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        trees, begin = np.unique(nodes["tree"].to_numpy(), return_index=True)
        span = int(nodes["node"].max()) + 2
        rank = np.searchsorted(trees, nodes["tree"].to_numpy())
        key = rank * span + nodes["node"].to_numpy(np.int64)
        here = np.arange(len(nodes))

        def child(name):
            to = nodes[name].to_numpy(np.float64)
            known = ~np.isnan(to)
            out = here.copy()
            out[known] = np.searchsorted(key, rank[known] * span + to[known].astype(np.int64))
            return out

        return cls(begin, trees, np.nan_to_num(nodes["feature"].to_numpy(np.float64), nan=0).astype(np.int64),
                   np.nan_to_num(nodes["threshold"].to_numpy(np.float64), nan=0.0), child("left"), child("right"),
                   nodes["prob"].to_numpy(np.float64))

    def walk(self, x: np.ndarray, depths: Sequence[int]):
        """Yields (depth, probabilities of rows x trees) for every cut depth, rising."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        depth = 0
        for cut in sorted(depths):
            while depth < cut:
                right = x[row, self.feature[at]] > self.threshold[at]
                new = np.where(right, self.right[at], self.left[at])
                depth += 1
                if (new == at).all():
                    depth = cut
                at = new
            yield cut, self.prob[at]


def _parts(nodes: DataFrame, limit: int) -> list[tuple[str, int, int]]:
    """(forest, tree, part): a forest's trees, dealt to parts of at most about ``limit`` nodes."""
    sizes = nodes.groupBy("forest", "tree").count().orderBy("forest", "tree").collect()   # one row per tree
    out, part, held, forest = [], -1, 0, None
    for r in sizes:
        if r.forest != forest or held + r["count"] > limit:
            part, held, forest = part + 1, 0, r.forest
        out.append((r.forest, r.tree, part))
        held += r["count"]
    return out


def cut_sums(rows: DataFrame, nodes: DataFrame, features: Sequence[str], counts: Sequence[int], depths: Sequence[int],
             keep: Sequence[str], forest_of: Column, limit: int = NODES_AT_ONCE) -> DataFrame:
    """(keep, forest, sums): for every row and each forest of ``forest_of`` (an
    array of names) the sums of its trees' probabilities under every cut: the
    forest's first ``count`` trees, each down to ``depth``; ``sums`` is ordered by
    depth, then count.

    A node table of at most ``limit`` rows travels with the tasks.  A larger one
    never meets the driver: its trees are dealt to parts, the rows to blocks, and
    each part is cogrouped with each block of its forest's rows.
    """
    counts, depths, keep = sorted(counts), sorted(depths), list(keep)
    names = [f"_x{i}" for i in range(len(features))]
    wide = rows.select(*keep, forest_of.alias("_forests"), *[F.col(f).cast("double").alias(n) for n, f in zip(names, features)])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    nodes = nodes.select("forest", "tree", "node", "feature", "threshold", "left", "right", "prob")

    def sums_of(name: str, forest: Forest, pdf: pd.DataFrame, keep: list[str]):
        first = [int(np.searchsorted(forest.trees, c)) for c in counts]
        for a in range(0, len(pdf), _SCORE_ROWS):
            block, sums = pdf.iloc[a:a + _SCORE_ROWS], []
            for _, prob in forest.walk(block[names].to_numpy(np.float64), depths):
                running = np.cumsum(prob, axis=1)
                sums += [running[:, k - 1] if k else np.zeros(len(block)) for k in first]
            yield block[keep].assign(forest=name, sums=list(np.stack(sums, axis=1)))

    if nodes.count() <= limit:
        forests = {name: Forest.of(group) for name, group in nodes.toPandas().groupby("forest")}

        def run(batches):
            for pdf in batches:
                for name, forest in forests.items():
                    yield from sums_of(name, forest, pdf[[name in f for f in pdf["_forests"]]], keep)

        return wide.mapInPandas(run, f"{kinds}, forest string, sums array<double>")

    spark, parts = nodes.sparkSession, _parts(nodes, limit)
    of_tree = spark.createDataFrame(parts, "forest string, tree int, _part int")                          # one row per tree
    of_forest = spark.createDataFrame(sorted({(f, p) for f, _, p in parts}), "forest string, _part int")
    wide = materialize(wide.withColumn("_n", F.monotonically_increasing_id()), "scored-rows")     # rows may be alike
    blocks = max(1, -(-wide.count() // BLOCK_ROWS))
    key, groups = ["forest", "_part", "_block"], blocks * (parts[-1][2] + 1)
    sent = (wide.withColumn("forest", F.explode("_forests")).drop("_forests").join(F.broadcast(of_forest), "forest")
            .withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)).cast("int")))
    held = (nodes.join(F.broadcast(of_tree), ["forest", "tree"])
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    columns = ["_n", *keep]

    def meet(key, pdf, group):
        found = list(sums_of(key[0], Forest.of(group), pdf, columns)) if len(group) and len(pdf) else []
        return pd.concat(found) if found else pd.DataFrame(columns=[*columns, "forest", "sums"])

    # few bytes and much work: an explicit number of partitions is not coalesced
    tasks = min(groups, 2_000)
    got = (sent.repartition(tasks, *key).groupBy(*key).cogroup(held.repartition(tasks, *key).groupBy(*key))
           .applyInPandas(meet, f"_n bigint, {kinds}, forest string, sums array<double>"))
    if len({f for f, _, _ in parts}) == parts[-1][2] + 1:
        return got.drop("_n")
    # exact decimals: the order in which parts are added cannot change a sum
    return got.groupBy("_n", *keep, "forest").agg(F.array(*[
        F.sum(F.get("sums", F.lit(i)).cast("decimal(28,16)")).cast("double") for i in range(len(counts) * len(depths))]).alias("sums")).drop("_n")


def score(rows: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "prob",
          limit: int = NODES_AT_ONCE) -> DataFrame:
    """``keep`` columns and the mean probability of class 1 over all trees of the table."""
    size = nodes.agg(F.max("tree").alias("t"), F.count_distinct("tree").alias("n")).first()
    sums = cut_sums(rows, nodes.withColumn("forest", F.lit("one")), features, [size.t + 1], [64], keep, F.array(F.lit("one")), limit)
    return sums.select(*keep, (F.get("sums", F.lit(0)) / size.n).alias(out))


def tree_expression(nodes: DataFrame, features: Sequence[str]) -> Column:
    """Class-1 probability of one tree of few levels as a nested expression over its features."""
    held = {r.node: r for r in nodes.collect()}                                # at most 2^(depth + 1) rows

    def of(node: int) -> Column:
        r = held[node]
        if r.feature is None:
            return F.lit(r.prob)
        return F.when(F.col(features[r.feature]).cast("double") <= r.threshold, of(r.left)).otherwise(of(r.right))
    return of(min(held))
