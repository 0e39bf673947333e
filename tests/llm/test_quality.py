"""Byte network: responses against a plain loop, its gradient against differences, held-out labels."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from chemscore.llm import quality as Q
from chemscore.llm.common import hash_share

from helpers import lines


def plain_logit(net, text):
    data = text.encode()
    halves = max(1, -(-len(data) // Q.HALF))
    padded = data + bytes(halves * Q.HALF + Q.WIDTH - len(data))
    best = []
    for c in range(max(1, halves - 1)):
        starts = [s for s in range(c * Q.HALF, min((c + 2) * Q.HALF, halves * Q.HALF), Q.STEP) if s < max(1, len(data))]
        x = np.array([net.vectors[list(padded[s:s + Q.WIDTH])].reshape(-1) for s in starts])
        best.append(np.maximum((x @ net.filters).max(axis=0) + net.bias, 0))
    best = np.array(best)
    return float(np.concatenate((best.mean(axis=0), best.max(axis=0), best.min(axis=0))) @ net.unit + net.offset[0])


def test_responses_equal_a_plain_loop():
    rnd, net = random.Random(5), Q.Network.fresh(3)
    texts = ["", "a", "ab", "x" * 255, "y" * 256, "z" * 257, "ä" * 400, "".join(rnd.choice("abc dé\n") for _ in range(9_000))]
    texts += ["".join(rnd.choice("abcdefg ") for _ in range(rnd.randrange(1, 1500))) for _ in range(20)]
    want = [plain_logit(net, t) for t in texts]
    got = net.combine(net.pool(texts))[-1]
    assert np.allclose(got, want, atol=1e-3)
    long = "word and word, " * 20_000                            # more halves than one piece holds
    assert abs(float(net.combine(net.pool([long]))[-1][0]) - plain_logit(net, long)) < 1e-3


def test_gradient_equals_differences():
    rnd = random.Random(2)
    net = Q.Network([w.astype(np.float64) for w in Q.Network.fresh(7).weights()])
    texts = ["".join(rnd.choice("abcdef ") for _ in range(n)) for n in (0, 3, 300, 900, 1300)]
    labels = np.array([0, 1, 0, 1, 1], float)

    def loss():
        p = 1 / (1 + np.exp(-net.combine(net.pool(texts))[-1]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for w, g in zip(net.weights(), net.gradient(texts, labels), strict=True):
        flat = w.reshape(-1)
        for i in rnd.sample(range(flat.size), min(12, flat.size)):
            was, eps = flat[i], 1e-3
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 2e-3, (w.shape, i)


def test_edge_rows_and_labels_of_one_kind(spark, frame):
    docs = frame([(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "long " * 100_000)])
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    assert model.weights is None and 0.5 < model.constant < 1
    rows = Q.score(docs, Q.Model(Q.Network.fresh().weights())).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == brute.held_out(r.doc_id) for r in rows)
    assert Q.score(docs.limit(0), model).collect() == []
    assert Q.fit(docs.limit(0), labels).constant == 0.5


def test_fit_is_bounded_and_reads_no_held_out_row(spark, frame):
    docs = frame([(i, f"text {i % 900}") for i in range(1500)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    texts = Q.training_texts(docs, labels, fit_rows=200)
    got = texts.collect()
    assert 120 < len(got) < 280 and len({r.text for r in got}) == len(got)
    taught = {d for d in range(1500) if not brute.held_out(d)}
    assert {r.text for r in Q.training_texts(docs, labels).collect()} == {f"text {d % 900}" for d in taught}


def test_hash_share(spark):
    h = F.xxhash64("id")
    n = spark.range(100_000).select(*[F.sum(hash_share(h, s).cast("int")).alias(f"s{i}") for i, s in
                                      enumerate((0.0, 1e-30, 0.25, 1.0))]).first()
    assert n.s0 == 0 and n.s1 == 0 and abs(n.s2 - 25_000) < 1_000 and n.s3 == 100_000


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = Q.score(docs, Q.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    right = [r for r in rows if r.predicted == r.quality]
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(right) > 0.97 * len(rows)
    assert sum(r.predicted for r in good) > 0.99 * len(good)
    assert sum(1 - r.predicted for r in bad) > 0.8 * len(bad)
