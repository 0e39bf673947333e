"""Learning operators.

Two learners share one form, the node table of ``operators.trees``:

* ``exact_forest`` and ``balanced_tree`` grow trees over every distinct value,
  as scikit-learn does (gini, ``max_features='sqrt'``, bootstrap by Poisson
  draws from md5, so that a fit is the same on any cluster);
* the grid search and its refit use binned forests, as Spark ML's random forest
  grows them (at most 64 bins a feature, the square root of the features, rounded
  up, at each node): ``n_estimators -> numTrees``, ``max_depth -> maxDepth``,
  ``min_samples_leaf -> minInstancesPerNode``.  ``min_samples_split`` has no
  counterpart, so grids collapse over it.

Grid search fits one forest per leaf size and fold, with the grid's most trees
and greatest depth, and scores all its settings by cutting that forest: the
first n of independent trees are a forest of n trees, and a greedily grown tree
cut at depth d is the tree grown to depth d.  Rows are counted by the cells of
their bins, and whole trees are grown in tasks (``operators.binned``).  Where the
features have too many cells for that, Spark ML grows the forests, from the
driver, so a few trees at a time and kept as node tables; the driver then never
holds more than about ``FIT_NODES`` nodes.  Folds are the explicit ``fold``
column (``operators.folds``), scored by exact ROC AUC; ties go to the first
setting in grid order, as with ``GridSearchCV``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chemscore.operators import binned as B
from chemscore.operators import folds as FO
from chemscore.operators import metrics as M
from chemscore.operators import trees as T
from chemscore.session import materialize, staged_path

SEED = 196          # random_state of the forest and of SMOTE
#: Nodes that all fits under way may hold on the driver at a time, at most about
#: (a kilobyte each), and trees of a forest's first fit, which shows their size.
FIT_NODES = 100_000
FIRST_TREES = 4

# scikit-learn grids of the three classifier scripts (fixed values)
REFERENCE_GRIDS = {
    "bace": {"n_estimators": [100, 120, 140, 160, 180, 198, 200], "max_depth": [10, 12, 14, 16, 18, 20],
             "min_samples_split": [2, 4], "min_samples_leaf": [1, 2]},
    "bbbp": {"n_estimators": [100, 120, 140, 160, 180, 200], "max_depth": [10, 12, 14, 16, 18, 20],
             "min_samples_split": [2, 4], "min_samples_leaf": [1, 2]},
    "clintox": {"n_estimators": [100, 120, 140, 160, 180, 200], "max_depth": [10, 12, 14, 16, 18, 20],
                "min_samples_split": [2, 4], "min_samples_leaf": [1, 2]},
}

# one setting of the grids (their first), for single fits
GRID_SETTING = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 1}


@dataclass
class GridResult:
    nodes: DataFrame          # node table of the best setting's forest, fitted on all rows
    table: DataFrame          # one row per setting: params, mean AUC
    best_params: dict
    folds: DataFrame          # param_id, fold, auc


def spark_grid(grid: dict) -> list[dict]:
    """M2: the cartesian grid in scikit-learn order (last key varies fastest),
    mapped to Spark parameter names; settings that differ only in
    ``min_samples_split`` collapse to their first occurrence."""
    keys = list(grid)
    out, seen = [], set()
    for combo in itertools.product(*[grid[k] for k in keys]):
        p = dict(zip(keys, combo))
        sp = {"numTrees": int(p.get("n_estimators", 100)), "maxDepth": min(int(p.get("max_depth", 5)), 30),
              "minInstancesPerNode": int(p.get("min_samples_leaf", 1))}
        key = tuple(sorted(sp.items()))
        if key not in seen:
            seen.add(key)
            out.append(sp)
    return out


def param_grid_table(spark: SparkSession, grid: dict) -> DataFrame:
    """M2 as a table ``(param_id, numTrees, maxDepth, minInstancesPerNode)``."""
    rows = [(i, g["numTrees"], g["maxDepth"], g["minInstancesPerNode"]) for i, g in enumerate(spark_grid(grid))]
    return spark.createDataFrame(rows, "param_id long, numTrees int, maxDepth int, minInstancesPerNode int")


def assembler(features: Sequence[str]) -> VectorAssembler:
    """The feature projection as a vector; invalid values fail the job."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def forest(seed: int = SEED, max_bins: int = 64, setting: dict | None = None) -> RandomForestClassifier:
    return RandomForestClassifier(**(setting or {}),
                                  featuresCol="features", labelCol="label", seed=seed,
                                  featureSubsetStrategy="sqrt", impurity="gini", bootstrap=True,
                                  maxBins=max_bins)


def positive_probability(pred: DataFrame, out: str = "prob") -> DataFrame:
    """``predict_proba[:, 1]``."""
    return pred.withColumn(out, vector_to_array(F.col("probability")).getItem(1))


def exact_forest(train: DataFrame, features: Sequence[str], id_col: str, setting: dict | None = None,
                 seed: int = SEED) -> DataFrame:
    """M1: the node table of a forest over every distinct value: Poisson bootstrap
    and, per node, the first int(sqrt(features)) of its features in drawn order
    that can split it."""
    s = setting or GRID_SETTING
    rows = T.bootstrap(train.select(id_col, "label", *features), s["numTrees"], id_col, seed)
    return T.grow(rows, features, s["maxDepth"], min_leaf=s["minInstancesPerNode"],
                  per_node=max(1, int(math.sqrt(len(features)))), seed=seed)


def fit_forest(train: DataFrame, features: Sequence[str], setting: dict, seed: int = SEED,
               held: int = FIT_NODES, name: str = "one") -> list[str]:
    """Folders with the node tables of a Spark ML forest named ``name``, whose trees
    are fitted so many at a time that about ``held`` nodes are on the driver.

    Trees are independent, so the forests of several fits are one; every fit has a
    seed of its own.  A single tree has at most two nodes per bin of all features."""
    spark, total, done, at_once, out = train.sparkSession, setting["numTrees"], 0, FIRST_TREES, []
    while done < total:
        n = min(at_once, total - done)
        rf = forest(seed + done, setting={**setting, "numTrees": n})
        model = Pipeline(stages=[assembler(features), rf]).fit(train).stages[-1]
        nodes = T.ml_nodes(spark, model).withColumn("tree", F.col("tree") + F.lit(done)).withColumn("forest", F.lit(name))
        out.append(staged_path(spark, "fitted-nodes"))
        nodes.write.parquet(out[-1])
        at_once = max(1, held * n // max(1, model.totalNumNodes))
        done += n
    return out


def forest_nodes(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """The node table that ``fit_forest`` has left in ``folders``."""
    return spark.read.schema(f"{T.NODES}, forest STRING").parquet(*folders)


def fold_forests(train: DataFrame, features: Sequence[str], leaves: Sequence[int], trees: int, depth: int, fold_col: str,
                 k: int, parallelism: int, seed: int = SEED, held: int = FIT_NODES) -> DataFrame:
    """Node tables of the forests fitted outside each fold, named ``leaf:fold``, staged."""
    cells = B.binned(train, features, fold_col, range(k))
    if cells is None:
        return spark_fold_forests(train, features, leaves, trees, depth, fold_col, k, parallelism, seed, held)
    return materialize(B.node_tables(train.sparkSession, [(f"{leaf}:{c.out}", c, leaf) for leaf in leaves for c in cells],
                                     trees, depth, seed), "forest-nodes")


def spark_fold_forests(train: DataFrame, features: Sequence[str], leaves: Sequence[int], trees: int, depth: int, fold_col: str,
                       k: int, parallelism: int, seed: int = SEED, held: int = FIT_NODES) -> DataFrame:
    """``fold_forests`` by Spark ML, for features of too many cells."""
    jobs = [(leaf, fold) for leaf in leaves for fold in range(k)]
    threads = min(parallelism, len(jobs))

    def one(leaf: int, fold: int) -> list[str]:
        return fit_forest(train.filter(F.col(fold_col) != fold), features,
                          {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf}, seed, held // threads, f"{leaf}:{fold}")

    with ThreadPool(threads) as pool:
        folders = pool.starmap(inheritable_thread_target(train.sparkSession)(one), jobs, chunksize=1)
    return forest_nodes(train.sparkSession, [f for fs in folders for f in fs])


def _axes(settings: list[dict]) -> tuple[list[int], list[int], list[int]]:
    counts, depths, leaves = (sorted({s[n] for s in settings}) for n in ("numTrees", "maxDepth", "minInstancesPerNode"))
    return counts, depths, leaves


def _by_setting(sums: DataFrame, settings: list[dict], leaf: Column, keep: Sequence[str]) -> DataFrame:
    """(keep, param_id, prob) of the ``sums`` that a forest of leaf size ``leaf`` (text) has under every cut."""
    counts, depths, leaves = _axes(settings)
    place = {(s["maxDepth"], s["numTrees"], s["minInstancesPerNode"]): i for i, s in enumerate(settings)}
    # Of each leaf size the settings' places in the grid, in the order of the sums.
    ids = F.create_map(*[x for n in leaves for x in (
        F.lit(str(n)), F.array(*[F.lit(place[d, c, n]) for d in depths for c in counts]))])
    cells = F.arrays_zip(F.element_at(ids, leaf).alias("param_id"), F.col("sums").alias("s"),
                         F.array(*[F.lit(c) for _ in depths for c in counts]).alias("n"))
    return sums.select(*keep, F.explode(cells).alias("c")).select(
        *keep, F.col("c.param_id").cast("long").alias("param_id"), (F.col("c.s") / F.col("c.n")).alias("prob"))


def setting_scores(train: DataFrame, nodes: DataFrame, features: Sequence[str], settings: list[dict], fold_col: str = "fold",
                   id_col: str = "doc_id", limit: int = T.NODES_AT_ONCE) -> DataFrame:
    """(id, fold, label, param_id, prob): every row under every setting, by the forests that have not seen its fold."""
    counts, depths, leaves = _axes(settings)
    mine = F.array(*[F.concat(F.lit(f"{leaf}:"), F.col(fold_col).cast("string")) for leaf in leaves])
    keep = [id_col, fold_col, "label"]
    sums = T.cut_sums(train, nodes, features, counts, depths, keep, mine, limit)
    return _by_setting(sums, settings, F.substring_index("forest", ":", 1), keep)


def cell_scores(spark: SparkSession, cells: Sequence[B.Cells], settings: list[dict], fold_col: str, seed: int = SEED) -> DataFrame:
    """(fold, label, times, param_id, prob): every cell of the rows left out under every
    setting, by the forest that has not seen them, with the rows of each class."""
    counts, depths, leaves = _axes(settings)
    sums = B.cut_sums(spark, cells, leaves, counts, depths, seed)
    rows = F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"h{y}").alias("times")) for y in (0, 1)])
    out = _by_setting(sums, settings, F.col("leaf").cast("string"), ["out", "h0", "h1"])
    return (out.select(F.col("out").alias(fold_col), "param_id", "prob", F.explode(rows).alias("r"))
            .select(fold_col, "param_id", "prob", "r.label", "r.times").where("times > 0"))


def grid_search_cv(train: DataFrame, features: Sequence[str], grid: dict, fold_col: str = "fold", parallelism: int = 8,
                   seed: int = SEED, k: int = 5, id_col: str = "doc_id", limit: int = B.CELLS_AT_ONCE) -> GridResult:
    """M3: k-fold grid search on ``fold_col``, exact AUC, refit of the best on all rows;
    by Spark ML's forests where there are more than ``limit`` cells."""
    settings, spark = spark_grid(grid), train.sparkSession
    counts, depths, leaves = _axes(settings)
    cells = B.binned(train, features, fold_col, [*range(k), None], limit=limit)
    if cells is None:
        nodes = spark_fold_forests(train, features, leaves, counts[-1], depths[-1], fold_col, k, parallelism, seed)
        scores = materialize(setting_scores(train, nodes, features, settings, fold_col, id_col)
                             .withColumn("label", F.col("label").cast("int")), "grid-scores")
    else:
        scores = materialize(cell_scores(spark, cells[:-1], settings, fold_col, seed), "grid-scores")
    folds = materialize(M.roc_auc(scores, "prob", "label", ["param_id", fold_col], None if cells is None else "times"), "grid-fold-scores")
    means = folds.groupBy("param_id").agg(F.avg(F.col("auc").cast("decimal(28,18)")).cast("double").alias("mean_auc"))
    table = materialize(param_grid_table(spark, grid).join(means, "param_id", "left"), "grid-table")
    best_i = M.cv_best(folds, "param_id").first()["param_id"]
    best = settings[int(best_i)] if best_i is not None else settings[0]
    if cells is None:
        best_nodes = forest_nodes(spark, fit_forest(train, features, best, seed))
    else:
        best_nodes = materialize(B.node_tables(spark, [("one", cells[-1], best["minInstancesPerNode"])], best["numTrees"],
                                               best["maxDepth"], seed), "forest-nodes")
    return GridResult(best_nodes, table, dict(best), folds)


def out_of_fold(data: DataFrame, features: Sequence[str], params: dict, k: int = 5,
                fold_col: str = "fold", seed: int = SEED) -> DataFrame:
    """Out-of-fold positive probabilities: fold ``f`` is scored by the setting
    ``params`` fitted on the other folds."""
    trees, depth, leaf = params["numTrees"], params["maxDepth"], params["minInstancesPerNode"]
    nodes = fold_forests(data, features, [leaf], trees, depth, fold_col, k, 8, seed)
    mine = F.array(F.concat(F.lit(f"{leaf}:"), F.col(fold_col).cast("string")))
    sums = T.cut_sums(data, nodes, features, [trees], [depth], ["label"], mine)
    return sums.select("label", (F.get("sums", F.lit(0)) / trees).alias("prob"))


def feature_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance, rank) of a node table, descending; a feature that splits nothing has 0."""
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "at int, name string")
    imp = T.importances(nodes).withColumnRenamed("feature", "at")
    return (names.join(imp, "at", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"),
                                                 "at")
            .withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "at")))  # a row a feature
            .drop("at"))


def balanced_tree(train: DataFrame, features: Sequence[str], max_depth: int = 4) -> DataFrame:
    """M5: the node table of the decision tree with ``class_weight='balanced'``:
    weights n / (k * n_c) in proportion, as integers."""
    c = train.agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("label").alias("n")).first()
    pos, neg = c.p or 0, c.n - (c.p or 0)
    shared = math.gcd(pos, neg) or 1
    return T.grow(train, features, max_depth, weights=(pos // shared or 1, neg // shared or 1))


@dataclass
class FlowResult:
    metrics: DataFrame        # (split, metric, value)
    grid: GridResult
    roc: DataFrame            # test split: threshold, tp, fp, tpr, fpr
    importances: DataFrame    # feature, importance, rank
    scored: DataFrame         # all rows with split, label, prob (staged)


def balance(train: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 5,
            seed: int = SEED) -> DataFrame:
    """The oversampled training rows: all rows and SMOTE's synthetic ones, with
    ids below all real ones so that folds come out the same in every run."""
    from chemscore.operators.smote import smote
    new = smote(train.withColumn(label, F.col(label).cast("long")), features, label, id_col, k, seed)
    low = train.agg(F.min(id_col)).first()[0]
    new = new.select((F.lit(int(low) - 1) - F.col("i")).alias(id_col), *features, F.col(label).cast("double").alias(label))
    return train.select(id_col, *features, label).unionByName(new)


def tune_and_apply(data: DataFrame, features: Sequence[str], grid: dict,
                   split_col: str = "split", k: int = 5, parallelism: int = 8,
                   threshold_on: str = "valid", id_col: str = "doc_id", oversample: bool = False) -> FlowResult:
    """M6: grid-search on train+valid (quirk Q13: validation rows are in the
    union), tune the Youden threshold on the validation split, report
    accuracy/AUC on validation (at argmax) and test (at the tuned threshold),
    the test split's ROC points and the importances.

    ``oversample`` balances the rows the grid search fits on (SMOTE).
    ``threshold_on='oof'`` removes the leak: the threshold is tuned on
    out-of-fold probabilities (each fold predicted by the best setting fitted
    on the other folds; k distributed fits).  Folds and scores are staged, so
    no fit recomputes them.
    """
    tv = data.filter(F.col(split_col).isin("train", "valid"))
    if oversample:
        tv = balance(tv, features, "label", id_col)
    tv = materialize(FO.stratified_folds(tv, "label", id_col, k, out="fold"), "learning-folds")
    res = grid_search_cv(tv, features, grid, "fold", parallelism, k=k, id_col=id_col)
    whole = data.withColumns({f: F.coalesce(F.col(f).cast("double"), F.raise_error(F.lit(f"null feature {f}")).cast("double"))
                              for f in features})
    scored = materialize(T.score(whole, res.nodes.drop("forest"), features, [id_col, split_col, "label"])
                         .withColumn("prediction", (F.col("prob") > 0.5).cast("double")), "learning-scores")
    valid = scored.filter(F.col(split_col) == ("valid" if threshold_on == "oof" else threshold_on))
    test = scored.filter(F.col(split_col) == "test")
    if threshold_on == "oof":
        t = M.scalar_threshold(out_of_fold(tv, features, res.best_params, k), "prob", "label")
    else:
        t = M.scalar_threshold(valid, "prob", "label")
    v_acc = M.accuracy(valid.withColumn("pred_i", F.col("prediction").cast("int")), "pred_i", "label")
    v_auc = M.roc_auc(valid, "prob", "label")
    t_acc = M.accuracy(M.apply_threshold(test, t, "prob"), "pred", "label")
    t_auc = M.roc_auc(test, "prob", "label")
    row = lambda df, split, metric, value: df.select(
        F.lit(split).alias("split"), F.lit(metric).alias("metric"), value.alias("value"))
    out = row(res.table.agg(F.max("mean_auc").alias("v")), "cv", "best_auc", F.col("v"))
    for part in (row(v_acc, "valid", "accuracy", F.col("accuracy")), row(v_auc, "valid", "auc", F.col("auc")),
                 row(data.sparkSession.range(1), "valid", "threshold", F.lit(float(t))),
                 row(t_acc, "test", "accuracy", F.col("accuracy")), row(t_auc, "test", "auc", F.col("auc"))):
        out = out.unionByName(part)
    return FlowResult(out, res, M.roc_curve(test, "prob", "label"), feature_importances(
        res.nodes, features), scored)
