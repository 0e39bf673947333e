"""Forests over binned features, whole trees grown inside tasks.

Continuous features are cut into at most ``MAX_BINS`` bins at the quantiles of
all training rows, so to a tree rows of the same bins are alike.  What a tree
needs of a training set is a row per *cell* (a combination of bins that occurs)
with its class counts: at most ``MAX_BINS`` to the number of features, however many
rows there are.  Cells are counted once for all training sets (one per fold left
out, and all rows); each set has its own bins.  Tasks then grow some trees each.

A row's bootstrap occurrences are Poisson draws of mean 1, so a cell of n rows is
drawn by the Poisson law of mean n.  Draws depend on the seed and the tree's number
only.  Rows of the fold left out go down with the training rows, with no weight:
while a tree grows, its probabilities under each cut come by the way.

Probabilities are held to 2^-40, so that sums over up to 4,096 trees are exact in
any order: rows score alike if their leaves do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore._ship import ship_by_value
from chemscore.operators.trees import NODES
from chemscore.session import materialize

ship_by_value(__name__)

MAX_BINS = 64
#: Cells of all training sets that travel with the tasks by way of the driver.
CELLS_AT_ONCE = 2_000_000
#: Trees that one task grows.
TREES_AT_ONCE = 20
_NO_FOLD = -(2**63)
_OUT_ROWS = 20_000


@dataclass
class Cells:
    """A training set: the fold left out (None: all rows), each feature's edges
    (rising; a value is in the bin of as many edges as lie below it) and by cell
    its bins and the rows of each class, in the set (``seen``) and left out (``held``)."""
    out: int | None
    edges: list[np.ndarray]
    bins: np.ndarray
    seen: np.ndarray
    held: np.ndarray


# ----- cells ------------------------------------------------------------------------------------

def _checked(column: Column, bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(text)).cast("double")).otherwise(column)


def _trains(fold: np.ndarray, out: int | None) -> np.ndarray:
    return np.ones(len(fold), bool) if out is None else (fold != out) & (fold != _NO_FOLD)


def _few_values(rows: DataFrame, names: Sequence[str], most: int) -> dict[int, list[float]]:
    """The values of the features that have at most ``most``."""
    def run(batches):
        held: list[set | None] = [set() for _ in names]
        for pdf in batches:
            for i, n in enumerate(names):
                if held[i] is not None:
                    held[i] |= set(pdf[n].unique())
                    if len(held[i]) > most:
                        held[i] = None
        yield pd.DataFrame([(i, v) for i, h in enumerate(held) for v in ([None] if h is None else h)], columns=["f", "value"])

    # at most so many values of a feature and task; a null where there are more
    found = rows.select(*names).mapInPandas(run, "f int, value double").groupBy("f").agg(
        F.array_sort(F.collect_set("value")).alias("values"), F.max(F.col("value").isNull()).alias("more")).collect()
    return {r.f: r["values"] for r in found if not r.more and len(r["values"]) <= most}


def _edges(rows: DataFrame, names: Sequence[str], outs: Sequence[int | None], bins: int) -> list[list[np.ndarray]]:
    """Per training set and feature: midway between neighbouring values, all of them
    or those at the set's quantiles."""
    few, probs = _few_values(rows, names, bins), [i / bins for i in range(1, bins)]
    fold = F.col("fold")
    mine = F.array_compact(F.array(*[F.lit(i) if o is None else F.when((fold != o) & (fold != _NO_FOLD), F.lit(i))
                                     for i, o in enumerate(outs)]))
    quantiles = {r.s: r for r in rows.select(F.explode(mine).alias("s"), *names).groupBy("s").agg(
        *[F.percentile_approx(n, probs).alias(n) for n in names]).collect()}
    for i, o in enumerate(outs):
        if i not in quantiles:
            raise ValueError("no rows to fit a forest on" + ("" if o is None else f" outside fold {o}"))
    cuts = [[np.array(few[f] if f in few else sorted(set(quantiles[i][n]))) for f, n in enumerate(names)] for i in range(len(outs))]

    def run(batches):
        low, high = ([[np.full(len(c) + 1, v) for c in of_set] for of_set in cuts] for v in (np.inf, -np.inf))
        for pdf in batches:
            fold = pdf["fold"].to_numpy()
            for s, o in enumerate(outs):
                part = pdf[_trains(fold, o)]
                for f, n in enumerate(names):
                    x = part[n].to_numpy()
                    b = np.searchsorted(cuts[s][f], x)
                    np.minimum.at(low[s][f], b, x)
                    np.maximum.at(high[s][f], b, x)
        yield pd.DataFrame([(s, f, b, *v) for s in range(len(outs)) for f in range(len(names))
                            for b, v in enumerate(zip(low[s][f], high[s][f])) if v[0] <= v[1]], columns=["s", "f", "b", "low", "high"])

    ends = rows.select("fold", *names).mapInPandas(run, "s int, f int, b int, low double, high double").groupBy("s", "f", "b").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("s", "f", "b").collect()      # a row per bin
    found: list[list[list]] = [[[] for _ in names] for _ in outs]
    for r in ends:
        found[r.s][r.f].append((r.low, r.high))

    def between(a: float, b: float) -> float:
        middle = a / 2 + b / 2
        return middle if a <= middle < b else a
    return [[np.array([between(a[1], b[0]) for a, b in zip(e, e[1:])]) for e in of_set] for of_set in found]


def binned(train: DataFrame, features: Sequence[str], fold_col: str, outs: Sequence[int | None], label: str = "label",
           bins: int = MAX_BINS, limit: int = CELLS_AT_ONCE) -> list[Cells] | None:
    """The cells of the training sets that leave out the folds ``outs``, or None if
    there are more than ``limit``.  Null and NaN features fail the job, and labels
    that are neither 0 nor 1."""
    names, outs = [f"x{i}" for i in range(len(features))], list(outs)
    values = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    rows = materialize(train.select(
        _checked(y, ~y.isin(0.0, 1.0), "label is neither 0 nor 1").cast("int").alias("y"),
        F.coalesce(F.col(fold_col).cast("long"), F.lit(_NO_FOLD)).alias("fold"),
        *[_checked(v, v.isNull() | F.isnan(v), f"null feature {f}").alias(n) for v, f, n in zip(values, features, names)]), "binned-rows")
    edges = _edges(rows, names, outs, bins)
    shapes = [[len(e) + 1 for e in of_set] for of_set in edges]
    if max(math.prod(s) for s in shapes) >= 2**62:
        return None

    def run(batches):
        for pdf in batches:
            fold, y = pdf["fold"].to_numpy(), pdf["y"].to_numpy()
            for s, o in enumerate(outs):
                seen = _trains(fold, o)
                held = np.zeros(len(fold), bool) if o is None else fold == o
                cell = np.zeros(len(fold), np.int64)
                for f, n in enumerate(names):
                    cell = cell * shapes[s][f] + np.searchsorted(edges[s][f], pdf[n].to_numpy())
                kind, at = np.unique(cell, return_inverse=True)
                counts = [np.bincount(at, mask & (y == k), len(kind)).astype(np.int64) for mask in (seen, held) for k in (0, 1)]
                out = pd.DataFrame(dict(zip(("s", "cell", "c0", "c1", "h0", "h1"), (s, kind, *counts))))
                yield out[np.sum(counts, axis=0) > 0]

    table = materialize(rows.mapInPandas(run, "s int, cell bigint, c0 bigint, c1 bigint, h0 bigint, h1 bigint").groupBy("s", "cell").agg(
        *[F.sum(c).alias(c) for c in ("c0", "c1", "h0", "h1")]), "forest-cells")
    if sum(math.prod(s) for s in shapes) > limit and table.count() > limit:
        return None
    got = table.toArrow().to_pandas().sort_values(["s", "cell"])
    out = []
    for s, o in enumerate(outs):
        part = got[got["s"] == s]
        bins_of = np.array(np.unravel_index(part["cell"].to_numpy(), shapes[s])).astype(np.uint16 if bins > 256 else np.uint8)
        out.append(Cells(o, edges[s], bins_of, part[["c0", "c1"]].to_numpy().T.copy(), part[["h0", "h1"]].to_numpy().T.copy()))
    return out


# ----- growth -------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in level order, from the root; a leaf's feature and left child are -1,
    a right child follows its left one."""
    counts: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    prob: np.ndarray


def _best_points(bins, order, weights, begin, totals, leaf):
    """Of each open node the best gain that its cells, in ``order`` of node and bin, have
    in one feature, and after which place of the order it is (the first of equal ones)."""
    size = np.diff(begin)
    node = np.repeat(np.arange(len(size)), size)
    b = bins[order]
    at = np.flatnonzero((b[1:] != b[:-1]) & (node[1:] == node[:-1]))
    best, place = np.zeros(len(size)), np.full(len(size), -1)
    if not len(at):
        return best, place, None
    own = node[at]
    run = [np.cumsum(w[order]) for w in weights]
    l0, l1 = (r[at] - np.concatenate([[0.0], r])[begin[own]] for r in run)
    r0, r1 = totals[0][own] - l0, totals[1][own] - l1
    left, right = l0 + l1, r0 + r1
    # size times the fall of the Gini impurity: zero exactly where the shares are equal
    gain = np.where((left >= leaf) & (right >= leaf), 2 * (l0 * r1 - l1 * r0) ** 2 / ((left + right) * left * right), 0.0)
    np.maximum.at(best, own, gain)
    hit = np.flatnonzero((gain == best[own]) & (gain > 0))[::-1]
    place[own[hit]] = hit
    return best, place, (b[at], l0, l1)


def _parted(orders, at, begin, split, opened):
    """The orders of the next level's open nodes, and where each begins; ``at`` is a
    cell's node there.  A node's range holds its children's cells mixed."""
    size = np.diff(begin)
    goes_on = np.zeros(len(size), bool)
    goes_on[split] = True
    keep, out, count = np.repeat(goes_on, size), [], np.zeros(len(opened), np.int64)
    for order in orders:
        order = order[keep]
        order = order[opened[at[order]]]
        child = at[order]
        right = child & 1
        count = np.bincount(child, minlength=len(opened))
        base = np.empty(len(opened), np.int64)              # cells of the children on the same side before this one
        for side in (0, 1):
            base[side::2] = np.cumsum(count[side::2]) - count[side::2]
        place = np.where(right == 1, np.cumsum(right), np.cumsum(1 - right)) - 1
        new = np.empty_like(order)
        new[(np.cumsum(count) - count - base)[child] + place] = order
        out.append(new)
    return out, np.concatenate([[0], np.cumsum(count[opened])])


def grow(cells: Cells, weights: np.ndarray, depth: int, leaf: int, per_node: int, rng: np.random.Generator,
         cuts: Sequence[int] = ()) -> tuple[Tree, list[np.ndarray]]:
    """A tree over cells that occur ``weights`` times (by class), and the probability of
    every cell where the tree is cut at each depth of ``cuts``.

    A node is split at the best of ``per_node`` drawn features while it is impure and
    a split with ``leaf`` rows on each side lessens its impurity."""
    kinds, n = cells.bins.shape
    share = cells.seen[1].sum() / max(1, cells.seen.sum())

    def probability(counts):
        whole = counts.sum(axis=0)
        return np.rint(np.where(whole > 0, counts[1] / np.maximum(whole, 1), share) * 2.0**40) / 2.0**40

    def is_open(counts):
        return (counts.min(axis=0) > 0) & (counts.sum(axis=0) >= 2 * leaf)

    counts = weights.sum(axis=1, keepdims=True)                     # of the newest level
    levels = []
    at = np.zeros(n, np.int64)                                      # node of each cell
    prob = np.full(n, probability(counts)[0])                       # and its probability
    weighed = np.flatnonzero(weights.sum(axis=0) > 0)
    orders = [weighed[np.argsort(b[weighed], kind="stable")] for b in cells.bins]
    todo, begin = np.flatnonzero(is_open(counts)), np.array([0, len(weighed)])    # open nodes, their places in the orders
    live, first, kept = np.arange(n), 0, {}                         # cells of open nodes; number of the level's first node
    for level in range(depth + 1):
        size = counts.shape[1]
        level_of = {"counts": counts, "feature": np.full(size, -1), "bin": np.full(size, -1), "gain": np.full(size, np.nan),
                    "left": np.full(size, -1), "prob": probability(counts)}
        levels.append(level_of)
        if level in cuts:
            kept[level] = prob.copy()
        if level == depth or not len(todo):
            break
        totals = counts[:, todo]
        points = [_best_points(b, o, weights, begin, totals, leaf) for b, o in zip(cells.bins, orders)]
        gains = np.stack([p[0] for p in points], axis=1)
        if per_node < kinds:
            drawn = np.argsort(rng.random(gains.shape), axis=1)[:, per_node:]
            np.put_along_axis(gains, drawn, 0.0, axis=1)
        feature, gain = gains.argmax(axis=1), gains.max(axis=1)
        split = np.flatnonzero(gain > 0)                            # of the open nodes
        if not len(split):
            break
        bin_at, left = np.zeros(len(todo), np.int64), np.zeros((2, len(todo)))
        for f, (_, place, found) in enumerate(points):
            mine = split[feature[split] == f]
            if len(mine):
                bin_at[mine], left[0, mine], left[1, mine] = (v[place[mine]] for v in found)
        to = np.full(size, -1)                                      # left child of a node, on the next level
        to[todo[split]] = 2 * np.arange(len(split))
        nodes = todo[split]
        level_of["feature"][nodes], level_of["bin"][nodes], level_of["gain"][nodes] = feature[split], bin_at[split], gain[split]
        level_of["left"][nodes] = first + size + to[nodes]
        # the next level: its nodes, and every cell's way there
        old, counts = counts, np.empty((2, 2 * len(split)))
        counts[:, ::2], counts[:, 1::2] = left[:, split], old[:, nodes] - left[:, split]
        live = live[to[at[live]] >= 0]
        here = at[live]
        at[live] = to[here] + (cells.bins[level_of["feature"][here], live] > level_of["bin"][here])
        prob[live] = probability(counts)[at[live]]
        opened = is_open(counts)
        todo = np.flatnonzero(opened)
        orders, begin = _parted(orders, at, begin, split, opened)
        live = live[opened[at[live]]]
        first += size
    for cut in cuts:
        kept.setdefault(cut, prob)
    whole = {k: np.concatenate([v[k] for v in levels], axis=-1) for k in levels[0]}
    return Tree(**whole), [kept[c] for c in cuts]


def _trees(cells: Cells, first: int, end: int, depth: int, leaf: int, seed: int, cuts: Sequence[int] = ()) -> Iterator:
    """(number, tree, probabilities of the cells by cut) of some trees of a forest: Poisson
    bootstrap, the square root of the features, rounded up, drawn at each node."""
    for tree in range(first, end):
        rng = np.random.default_rng([seed % 2**64, tree])
        weights = rng.poisson(cells.seen).astype(np.float64)
        yield tree, *grow(cells, weights, depth, leaf, math.ceil(math.sqrt(len(cells.edges))), rng, cuts)


def _blocks(trees: int, ends: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Ranges of at most ``TREES_AT_ONCE`` trees, none of which reaches over one of ``ends``."""
    marks = sorted({0, trees, *(e for e in ends if e < trees), *range(TREES_AT_ONCE, trees, TREES_AT_ONCE)})
    return list(zip(marks, marks[1:]))


def _run_jobs(spark: SparkSession, jobs: Sequence[tuple], one, schema: str) -> DataFrame:
    """What ``one`` yields for each job, a task each."""
    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield from one(*jobs[i])

    return spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, schema)


def node_tables(spark: SparkSession, forests: Sequence[tuple[str, Cells, int]], trees: int, depth: int, seed: int) -> DataFrame:
    """The node tables of the forests (name, training set, leaf size)."""
    jobs = [(name, cells, leaf, *block) for name, cells, leaf in forests for block in _blocks(trees)]

    def one(name: str, cells: Cells, leaf: int, first: int, end: int):
        for number, t, _ in _trees(cells, first, end, depth, leaf, seed):
            inner = t.left >= 0
            threshold = np.full(len(inner), np.nan)
            threshold[inner] = [cells.edges[f][b] for f, b in zip(t.feature[inner], t.bin[inner])]
            kids = [pd.arrays.IntegerArray(v.astype(np.int64), ~inner) for v in (t.feature, t.left, t.left + 1)]
            yield pd.DataFrame({"tree": number, "node": np.arange(len(inner)), "c0": t.counts[0], "c1": t.counts[1], "feature": kids[0],
                                "threshold": threshold, "gain": t.gain, "left": kids[1], "right": kids[2], "prob": t.prob,
                                "forest": name})

    return _run_jobs(spark, jobs, one, f"{NODES}, forest STRING")


def cut_sums(spark: SparkSession, sets: Sequence[Cells], leaves: Sequence[int], counts: Sequence[int], depths: Sequence[int],
             seed: int) -> DataFrame:
    """(out, leaf, cell, h0, h1, sums): for each training set and leaf size, by cell of the
    fold left out its rows of each class and the sums of the trees' probabilities
    under every cut, ordered by depth, then count."""
    counts, depths = sorted(counts), sorted(depths)
    jobs = [(cells, leaf, *block) for cells in sets for leaf in leaves for block in _blocks(counts[-1], counts)]

    def one(cells: Cells, leaf: int, first: int, end: int):
        tested = np.flatnonzero(cells.held.sum(axis=0))
        sums = np.zeros((len(depths), len(tested)))
        for _, _, probs in _trees(cells, first, end, depths[-1], leaf, seed, depths):
            for i, p in enumerate(probs):
                sums[i] += p[tested]
        for a in range(0, len(tested), _OUT_ROWS):
            part = slice(a, a + _OUT_ROWS)
            yield pd.DataFrame({"out": cells.out, "leaf": leaf, "last": end, "cell": tested[part], "h0": cells.held[0, tested[part]],
                                "h1": cells.held[1, tested[part]], **{f"d{i}": v[part] for i, v in enumerate(sums)}})

    columns = ", ".join(f"d{i} double" for i in range(len(depths)))
    got = _run_jobs(spark, jobs, one, f"out bigint, leaf int, last int, cell bigint, h0 bigint, h1 bigint, {columns}")
    return got.groupBy("out", "leaf", "cell", "h0", "h1").agg(F.array(*[
        F.sum(F.when(F.col("last") <= n, F.col(f"d{i}")).otherwise(0.0)) for i in range(len(depths)) for n in counts]).alias("sums"))
