"""Conversation prefix trie against a plain trie of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chemscore.llm import prefix_trie as T

from helpers import lines

TYPES = "conv_id long, turn long, role string, text string, path string, n long, low long, depth long, h long"


def plain(rows, group=5, heads=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            name = hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, name, key))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - int(np.fmod(c, group)), [])[:h] + turns[h:])
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1,
                   sum(b[1] for b in below) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0))
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
                   for p, m in nodes.items()), key=str)


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], TYPES)
    out = T.conversation_trie(df, **how)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(out.columns) == sorted(names)
    assert lines(out.select(names)) == plain(rows)


def test_edge_rows(spark):
    long = "ä" * 50_000
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, None, long), (1, 0, "user", "a"),
            (1, 0, "bot", "b"), (None, 0, "user", "lost"), (7, 0, "user", ""), (-3, 0, "user", "a"), (-3, 9, "user", "z"),
            (-5, 3, "user", "q"), (12, 5, "user", "late"), (13, 1, "1:u", "x"), (14, 1, "1", ":ux")]
    check(spark, rows)


def test_empty_and_turnless(spark):
    check(spark, [])
    check(spark, [(3, 0, "user", "one turn only, and no head")])


@pytest.mark.parametrize("block_turns", [40, 400, 250_000])
def test_copies_and_shared_heads_in_several_rounds(spark, block_turns):
    rnd = random.Random(block_turns)
    rows = []
    for c in range(400):
        kind = rnd.random()
        if kind < 0.3:                                          # a third are copies of one conversation
            turns = ["hot"] * 12
        elif kind < 0.7:                                        # the same first turns, then some of their own
            turns = ["hot"] * rnd.randrange(1, 12) + [rnd.choice("abc") for _ in range(rnd.randrange(4))]
        else:
            turns = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 14))]
        rows += [(c, i, ("user", "bot")[i % 2], t) for i, t in enumerate(turns)]
    check(spark, rows, block_turns=block_turns)


def test_one_long_conversation(spark):
    rows = [(5, i, "user", str(i % 7)) for i in range(3000)] + [(c, i, "user", str(i % 7)) for c in (10, 15, 20) for i in range(200)]
    check(spark, rows, block_turns=300)


def test_range_minima():
    rnd = np.random.default_rng(3)
    values = rnd.integers(0, 6, 200)
    table = T.RangeMin(values)
    at, depth = rnd.integers(0, 200, 500), rnd.integers(1, 6, 500)
    right, left = table.reach_right(at, depth), table.reach_left(at, depth)
    for a, d, r, l in zip(at, depth, right, left, strict=True):
        assert all(values[a + 1:r + 1] >= d) and (r == 199 or values[r + 1] < d)
        assert all(values[l + 1:a + 1] >= d) and (l == 0 or values[l] < d)
    b = rnd.integers(0, 199, 300)
    e = np.array([rnd.integers(x + 1, 201) for x in b])
    assert list(table.least(b, e)) == [min(values[x:y]) for x, y in zip(b, e, strict=True)]
