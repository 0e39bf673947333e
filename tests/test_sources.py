"""JSON array file, CSV scan with explicit schema, model and metric sinks."""

import json
import os

from pyspark.sql import functions as F

from chemscore.operators import ml, trees
from chemscore.sources import files, records


def test_json_array_file(spark, scratch):
    path = os.path.join(scratch, "train.json")
    data = [{"instruction": "Task: bbbp", "input": "Predict C1CC", "output": True},
            {"instruction": "Task: bace", "input": "Predict CCO", "output": "False"},
            {"instruction": "x", "input": "y", "output": None}]
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(data, fh, indent=2)
    rec = records.read_json_array(spark, path)
    got = records.to_samples(rec).collect()
    assert [r.answer for r in got] == ["True", "False", "None"]
    assert got[0].prompt[0].role == "system" and got[0].prompt[1].content == "Predict C1CC"


def test_csv_scan_and_label_cast(spark, scratch):
    path = os.path.join(scratch, "bbbp.csv")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write("SMILES,LogP,MW,HBD,HBA,TPSA,Charge,ARings,AroAtoms,p_np\r\n")
        fh.write("CCO,0.5,111.25,3,7,10.5,0,2,9,False\r\n")
        fh.write("CCN,-1.5,222.75,4,8,20.25,1,3,12,1.0\r\n")
    df = files.read_csv(spark, path, files.CSV_SCHEMAS["bbbp"])
    rows = df.select("SMILES", "MW", "AroAtoms", "label").orderBy("SMILES").collect()
    assert [(r.SMILES, r.label) for r in rows] == [("CCN", 1), ("CCO", 0)]
    assert rows[1].MW == 111.25 and rows[1].AroAtoms == 9


def test_model_save_load_and_metric_sink(spark, scratch):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i % 2)) for i in range(40)], "a double, b double, label double")
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[ml.assembler(["a", "b"]), ml.forest().setNumTrees(5).setMaxDepth(3)]).fit(df)
    path = os.path.join(scratch, "model")
    files.save_model(model, path)
    again = files.load_model(path)
    p1 = [r.probability for r in model.transform(df).collect()]
    p2 = [r.probability for r in again.transform(df).collect()]
    assert p1 == p2
    imp = ml.feature_importances(trees.ml_nodes(spark, model.stages[-1]), ["a", "b"])
    out = os.path.join(scratch, "importances")
    files.write_metrics(imp, out)
    assert spark.read.parquet(out).count() == 2


def test_spark_grid_sizes():
    assert len(ml.spark_grid(ml.REFERENCE_GRIDS["bace"])) == 84
    assert len(ml.spark_grid(ml.REFERENCE_GRIDS["bbbp"])) == 72


def test_answer_to_string_variants(spark):
    df = spark.createDataFrame([('[{"instruction":"a","input":"b","output":false},{"instruction":"a","input":"b","output":"x"}]',)], "js string")
    rec = records.records_from_column(df, "js")
    assert [r.a for r in rec.select(records.answer_to_string(F.col("output")).alias("a")).collect()] == ["False", "x"]


def test_bad_records_fail(spark, scratch):
    import pytest
    whole = '[{"instruction":"a","input":"b","output":true}]'
    for bad in (whole[:-9], '[{"instruction":"a","input":"b"}]', '[{"input":"b","output":1}]'):
        df = spark.createDataFrame([(whole,), (bad,)], "js string")
        with pytest.raises(Exception, match="(?i)malformed|without the key|FAILFAST"):
            records.records_from_column(df, "js").collect()
    explicit = spark.createDataFrame([('[{"instruction":null,"input":"b","output":null}]',), (None,)], "js string")
    assert [r.instruction for r in records.records_from_column(explicit, "js").collect()] == [None]


def test_json_lines_and_nested_outputs(spark, scratch):
    path = os.path.join(scratch, "train.jsonl")
    with open(path, "w", encoding="utf-8") as fh:
        for v in (True, ["q", 1], {"k": None}, None):
            fh.write(json.dumps({"instruction": "i", "input": "n", "output": v}) + "\n")
    rec = records.read_json_lines(spark, path)
    got = [r.answer for r in records.to_samples(rec, nested=True).collect()]
    assert sorted(got) == sorted(["True", "['q', 1]", "{'k': None}", "None"])


def test_tune_and_apply_oof(spark):
    import random
    rnd = random.Random(2)
    rows = []
    for i in range(160):
        y = i % 3 != 0
        rows.append((i, float(y), ("test", "valid", "train", "train", "train")[i % 5],
                     rnd.gauss(2.0 if y else 0.0, 1.0), rnd.gauss(0, 1)))
    df = spark.createDataFrame(rows, "doc_id long, label double, split string, a double, b double")
    grid = {"n_estimators": [10], "max_depth": [3], "min_samples_leaf": [1]}
    for mode, more in (("oof", False), ("valid", True)):
        flow = ml.tune_and_apply(df, ["a", "b"], grid, k=3, threshold_on=mode, oversample=more)
        got = {(r.split, r.metric): r.value for r in flow.metrics.collect()}
        assert 0.5 < got[("test", "auc")] <= 1.0
        assert ("valid", "threshold") in got
        assert flow.roc.count() > 2 and flow.importances.count() == 2
    tv = df.filter("split <> 'test'")
    both = ml.balance(tv, ["a", "b"], "label", "doc_id").groupBy("label").count().collect()
    assert len({r["count"] for r in both}) == 1 and both[0]["count"] > tv.count() // 2
