"""One JSON array read by many tasks, run-keyed metric commits, reduced ROC curves."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chemscore.operators import metrics as M
from chemscore.operators.ordering import next_values
from chemscore.sources import files, records


def _array(path, items, indent=None):
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(items, fh, ensure_ascii=random.Random(len(items)).random() < 0.5, indent=indent)


def _hostile(n, seed):
    rnd = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\", '\\"', "\\\\", "}]", ',{"a":1}', "\n", "\t", "é", "\U0001f600", "x", " ", '"}', "\\}", ":"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))
    outputs = [True, False, None, "}", "plain", '"quoted"']
    return [{"instruction": text(), "input": text(), "output": rnd.choice(outputs),
             **({"more": {"deep": [text(), {"k}": [1, "]"]}]}} if rnd.random() < 0.3 else {})} for _ in range(n)]


def _samples(df):
    return sorted(map(tuple, df.select("instruction", "input", records.answer_to_string(F.col("output")).alias("a")).collect()), key=str)


@pytest.mark.parametrize("indent", [None, 2])
def test_split_array_equals_the_one_task_form(spark, scratch, indent):
    items = _hostile(400, 7 + (indent or 0))
    _array(os.path.join(scratch, "one.json"), items, indent)
    _array(os.path.join(scratch, "two.json"), items[:30], indent)
    _array(os.path.join(scratch, "none.json"), [], indent)
    _array(os.path.join(scratch, "single.json"), [{"instruction": "}" * 5_000, "input": "{" * 5_000, "output": "x"}], indent)
    want = _samples(records.read_json_array(spark, scratch))
    assert len(want) == 431
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1500")
        assert spark.read.option("lineSep", "}").text(scratch).rdd.getNumPartitions() > 20
        got = _samples(records.read_json_array_split(spark, scratch))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert _samples(records.read_json_array_split(spark, scratch)) == want


@pytest.mark.parametrize("text", ['[{"instruction":"a","input":"b","output":true}', '[{"instruction":"a","input":"b","output":"tru}]',
                                  '[{"instruction":"a","input":"b","output":true}] x', '[1,{"instruction":"a","input":"b","output":1}]',
                                  '[{"instruction":"a","input":"b"}]', '[{"instruction":"a","input":"b","output":1}', "[{"])
def test_malformed_arrays_fail(spark, scratch, text):
    with open(os.path.join(scratch, "bad.json"), "w") as fh:
        fh.write(text)
    with pytest.raises(Exception, match="(?i)malformed|without the key|FAILFAST"):
        records.read_json_array_split(spark, scratch).collect()


def test_runs_replace_only_themselves(spark, scratch):
    path = os.path.join(scratch, "metrics")
    rows = lambda *r: spark.createDataFrame(r, "split string, metric string, value double")
    files.commit_metrics(rows(("test", "auc", 0.5), ("valid", "auc", 0.6), ("test", "roc", 1.0), ("test", "roc", 2.0)), path, "r1")
    files.commit_metrics(rows(("test", "auc", 0.9)), path, "r2")
    files.commit_metrics(rows(("test", "auc", 0.7), ("test", "roc", 3.0)), path, "r1")          # repeated, with other values
    files.commit_metrics(rows(("test", "auc", 0.7), ("test", "roc", 3.0)), path, "r1")          # and once more
    got = files.read_metrics(spark, path, "value double, run string, split string, metric string")
    assert sorted((r.run, r.split, r.metric, r.value) for r in got.collect()) == [
        ("r1", "test", "auc", 0.7), ("r1", "test", "roc", 3.0), ("r1", "valid", "auc", 0.6), ("r2", "test", "auc", 0.9)]
    with pytest.raises(ValueError, match="split"):
        files.commit_metrics(spark.range(1).withColumn("metric", F.lit("x")), path, "r3")


def _reduced_by_hand(points):
    out = []
    for i, p in enumerate(points):
        if 0 < i < len(points) - 1:
            a, b = points[i - 1], points[i + 1]
            if b[1] - 2 * p[1] + a[1] == 0 and b[2] - 2 * p[2] + a[2] == 0:
                continue
        out.append(p)
    return out


@pytest.mark.parametrize("levels", [1, 2, 9, 300])
def test_reduced_curve_keeps_the_corners(spark, levels):
    rnd = random.Random(levels)
    # runs of equal labels give straight lines
    rows = [(g, float(rnd.randrange(levels)), int((i // 7 + g) % 2)) for g in (0, 1) for i in range(200)]
    rows += [(0, levels + 0.5 * i, 1) for i in range(12)] + [(1, -1.0 - i, 0) for i in range(15)]
    df = spark.createDataFrame(rows, "g long, score double, label int")
    full = {}
    for r in M.roc_curve(df, by=["g"]).where("threshold < double('inf')").orderBy(F.desc("threshold")).collect():
        full.setdefault(r.g, []).append((r.threshold, r.tp, r.fp))
    got = {}
    for r in M.roc_curve(df, by=["g"], drop_intermediate=True).orderBy(F.desc("threshold")).collect():
        got.setdefault(r.g, []).append((r.threshold, r.tp, r.fp))
    for g in full:
        assert got[g][0] == (float("inf"), 0, 0) and got[g][1:] == _reduced_by_hand(full[g])
    assert sum(map(len, got.values())) < sum(map(len, full.values())) + 2


def test_followers_cross_bucket_borders(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id")).cast("double").alias("x"), "id")
    for descending in (False, True):
        rows = next_values(df, ["g"], "x", ["id"], descending=descending, buckets=16).collect()
        step = -3 if descending else 3
        assert len(rows) == 500
        for r in rows:
            after = r.id + step
            assert (r.next.id if r.next else None) == (after if 0 <= after < 500 else None)
