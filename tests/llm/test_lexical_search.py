"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chemscore.llm import lexical_search as S

from helpers import lines

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, t in ((d, plain_terms(x)) for d, x in docs) if t]
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def check(spark, frame, docs, items, **how):
    df = spark.createDataFrame([(*i, "x", 1, 2) for i in items], "item_id long, text string, doc_id string, rank int, q int")
    out = S.search(frame(docs), df, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert lines(out) == plain(docs, items, how.get("k", 20))


def test_edge_rows(spark, frame):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Straße ÀB Ab_aB"), (4, "Straße ÀB Ab_aB"), (None, "ab ab straße"), (5, "x1 " * 30_000 + "ab"),
            (6, "other words"), (7, "AB àb")]
    items = [(1, "ab AB straße"), (1, "ab AB straße"), (1, "other"), (2, None), (3, "?!"), (None, "x1"), (4, "unknown"), (5, "àb")]
    check(spark, frame, docs, items)
    check(spark, frame, docs, [])
    check(spark, frame, [], items)
    check(spark, frame, docs, items, query_bytes=20)             # several passes


@pytest.mark.parametrize("block_postings", [50, 1_000_000])
def test_ties_copies_and_frequent_words(spark, frame, block_postings):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(vocabulary[min(int(rnd.expovariate(0.15)), 59)] for _ in range(rnd.randrange(1, 40)))
    copied = text()
    docs = [(i, copied if rnd.random() < 0.33 else text()) for i in rnd.sample(range(10_000), 600)]
    check(spark, frame, docs, [(i, text()) for i in range(25)] + [(99, copied)], k=7, block_postings=block_postings)


def test_search_stops_early_and_strictly_below_the_kth_score():
    """One list of falling impacts: reading stops once what is unseen is below the k-th score, not at it."""
    impact = np.concatenate((np.arange(5000, 4990, -1), np.full(40, 4000), np.arange(3000, 0, -1)))
    doc = np.arange(len(impact))[::-1].copy()                    # the highest scores have the largest ids
    lists = S.ImpactLists(doc, np.zeros(len(doc), np.int64), impact, 1)
    best = S.Best(20)
    scored = S.best_positions(lists, {0: 1}, np.arange(len(doc)), best, step=4)
    assert 50 <= scored < 200
    order = sorted(zip(-impact, doc))[:20]
    assert [(-s, d) for s, d in zip(best.score, best.doc)] == [(s, d) for s, d in order]


def test_look_ups_move_best_positions():
    """What direct accesses have seen counts: a document read in one list opens the other's first places."""
    doc, term = np.array([0, 1, 2, 3] * 2), np.repeat([0, 1], 4)
    lists = S.ImpactLists(doc, term, np.array([9, 8, 7, 1, 9, 8, 7, 1]), 2)
    best = S.Best(3)
    assert S.best_positions(lists, {0: 1, 1: 2}, np.arange(4), best, step=3) == 3
    assert list(best.score) == [27, 24, 21]
