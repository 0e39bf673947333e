"""Operators 3 and 9 and the pipeline against plain versions."""

import random

import numpy as np
import pytest

import brute
from chemscore.llm import near_dups, topk

from helpers import lines


def top_k_brute(rows, queries, k):
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {(i, tuple(v)) for i, v in usable if i in queries}
    for q, v in sorted(asked):
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j if j is not None else 0) for j, w in usable
                  if j != q and len(w) == len(v)]
        out += [(q, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("chunk,bins", [(8192, 256), (2, 4)])
def test_top_k(spark, chunk, bins):
    r = random.Random(9)
    rows = [(i, [r.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(4)]) for i in range(120)]      # many ties
    rows += [(200 + i, [0.25] * 4) for i in range(40)] + [(None, [1.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]),
             (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [0.5, 0.5]), (305, [0.5, 1.0]), (306, []),
             (307, [3.0e38, 0.0, 0.0, 1.0]), rows[7], rows[50]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    queries = df.where("vec_id % 50 = 0 or vec_id in (304, 306, 302)")
    finite = [(i, None if v and any(x is not None and abs(x) > 1e30 for x in v) else v) for i, v in rows]
    want = top_k_brute(finite, {0, 50, 100, 200, 250, 300, 304, 306, 302}, 5)
    assert lines(topk.top_k(df, queries, 5, chunk, bins)) == sorted(want, key=str)
    assert topk.top_k(df.limit(0), queries.limit(0)).count() == 0


def test_top_k_large_scores_are_exact(spark):
    rows = [(i, [200_000.0 + i, 150_000.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert lines(topk.top_k(df, df.where("vec_id = 0"), 3)) == sorted(top_k_brute(rows, {0}, 3), key=str)


def test_top_k_takes_all_finite_vectors(spark):
    rows = [(i, [1.0 + i / 2 ** 40, -0.5, 2.0 ** -20 * i]) for i in range(20)]               # doubles that no float holds
    rows += [(50 + i, [float(2 ** 30 + i), 3.0 - i, -1e6 * i]) for i in range(8)] + [(60, [-4e6, 5e8, 1.0]), (61, [1e300, 0.0, 0.0]),
             (62, [0.0, 1e-300, 1e17]), (63, [0.0, float("inf"), 0.0]), (64, [1.7e308, -1.7e308, 0.0]), (65, [-5e9, 5e9, 5e9])]
    exact = [(i, [int(x * 256 // 1) if abs(x) < 1e15 else 256 * int(x) for x in v]) for i, v in rows if i != 63]
    want = []
    for q, v in exact:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in exact if j != q]
        scores = sorted(s for s in scores if -2 ** 63 <= -s[0] < 2 ** 63)
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores[:4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df, 4).collect())) == sorted(want)
    assert sorted(map(tuple, topk.top_k(df, df, 4, 20, 64).collect())) == sorted(want)


def test_top_k_of_clustered_vectors_is_whole(spark):
    r = np.random.default_rng(12)
    v = (r.normal(size=(25, 8))[r.integers(0, 25, 10_000)] + r.normal(scale=0.03, size=(10_000, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8)
    found = {}
    for q, _, i, s in sorted(map(tuple, topk.top_k(df, df, 5).collect())):
        found.setdefault(q, []).append((i, s))
    e = np.floor(256 * v.astype(np.float64))
    wrong = 0
    for q in range(len(v)):
        scores = (e @ e[q]).astype(np.int64)
        scores[q] = -2 ** 62
        best = np.lexsort((np.arange(len(v)), -scores))[:5]
        wrong += found.get(q) != [(int(i), int(scores[i])) for i in best]
    assert wrong == 0


def copies(r, n_words, n, edits):
    base = [f"w{r.randrange(5000)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(11)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d e", "A B C D E", "a b c d f", "é b c d e", "É b c d e"]
    for _ in range(12):
        texts += copies(r, r.choice([12, 40, 150]), r.randint(1, 8), r.choice([1, 3, 6]))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{r.randrange(10 ** 6)}" for _ in range(r.randint(5, 80))) for _ in range(40)]
    texts += copies(r, 100, 150, 4)                                # a large group of near copies
    base = [f"c{i}" for i in range(200)]                           # a chain: each like the next only
    texts += [" ".join(base[i * 8:i * 8 + 100]) for i in range(12)]
    texts += ["z " * 30_000]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_near_duplicates(frame, near_rows):
    got = near_dups.near_duplicates(frame(near_rows)).drop("class_id", "text_key")
    assert lines(got) == sorted(brute.near_duplicates(near_rows), key=str)


def test_near_duplicates_long_lists_and_shuffles(frame, near_rows, monkeypatch):
    monkeypatch.setattr(near_dups, "LIST_ROWS", 3)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dups, "small", lambda df, rows=0: df)  # shuffles in place of broadcasts
    got = near_dups.near_duplicates(frame(near_rows)).drop("class_id", "text_key")
    assert lines(got) == sorted(brute.near_duplicates(near_rows), key=str)


def test_near_duplicates_repeated_and_null_ids(frame):
    text = "a b c d e f g h i j"
    got = lines(near_dups.near_duplicates(frame([(3, text), (3, text), (1, text.upper()), (None, text), (None, None)])).drop("text_key"))
    assert got == sorted([(3, 6, 1, False, 1), (3, 6, 1, False, 1), (1, 6, 1, True, 1), (None, 6, None, True, 1),
                          (None, 0, None, True, None)], key=str)
    assert near_dups.near_duplicates(frame([])).count() == 0


def test_components_of_long_chains(spark):
    r = random.Random(1)
    ids = list(range(200))
    r.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[i], ids[i + 1]) for i in range(100, 199)]
    got = {x.node: x.component for x in near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: min(ids[:100]) for i in ids[:100]} | {i: min(ids[100:]) for i in ids[100:]}
    assert got == want
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).count() == 0
