"""Golden text cases (FIXTURES section 3) for X*, R1-R3."""

from pyspark.sql import functions as F

from chemscore.functions import text as X

N = "\n"
CASES = [
    (f"<name>{N}LogP: improve, MW: not improve, TPSA: improve{N}</name>{N}<answer>{N}True{N}</answer>",
     1.0, "True", 2.0, -1.5, [("LogP", 1), ("MW", 1), ("TPSA", 1)]),
    ("<name>LogP: improve, MW: not improve, HBD: worse</name><answer>True</answer>",
     1.0, "True", 2.0, 0.0, [("LogP", 1), ("MW", 1), ("HBD", -1)]),
    ("<name>LogP: improve, MW: improve</name> <answer>False</answer>", 1.0, "False", 0.0, -1.0,
     [("LogP", 1), ("MW", 1)]),
    ("<name>a: improve,b: improve,c:improve</name> text <answer>True</answer>", -2.0, "True", 2.0, 0.0,
     [("a", 1), ("b", 1), ("c", 1)]),
    ("<answer>True</answer>", -2.0, "True", 2.0, -1.5, []),
    ("", -2.0, "", 0.0, -1.5, []),
    ("<name>LogP: improve: x, MW, :improve, , HBD: Improved</name><answer>it is True</answer>", 1.0,
     "it is True", 2.0, 0.0, [("", 1), ("HBD", 1)]),
    (f"<think>..</think><name>a:improve</name><name>{N}b:improve{N}</name><answer>False</answer></answer>",
     1.0, "False", 0.0, -1.0, [("a", 1)]),
]


def test_golden_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    rows = df.select("i", X.reward_format("c").alias("f"), X.extract_answer("c").alias("a"),
                     X.reward_correctness(X.extract_answer("c"), F.lit("True")).alias("cor"),
                     X.reward_choice_count("c").alias("n"), X.parse_claims("c").alias("cl")).orderBy("i").collect()
    for r, (_, f, a, cor, n, claims) in zip(rows, CASES):
        assert r.f == f and r.a == a and r.cor == cor and r.n == n
        assert [(x.prop, x.label) for x in r.cl] == claims


def test_greedy_and_hash_and_template(spark):
    df = spark.createDataFrame([("<answer> a </answer> x <answer> b </answer>", "q #### 42 #### z")], "c string, h string")
    r = df.select(X.extract_answer("c").alias("lazy"), X.extract_answer("c", greedy=True).alias("greedy"),
                  X.extract_hash_answer("h").alias("hash"), X.extract_hash_answer(F.lit("none")).alias("none"),
                  X.format_template(F.lit("n"), F.lit(None).cast("string")).alias("t")).first()
    assert r.lazy == "a"
    assert r.greedy == "a </answer> x <answer> b"
    assert r.hash == "42" and r.none is None
    assert r.t == "\n<name>\nn\n</name>\n<answer>\nNone\n</answer>\n"


def test_unicode_strip_and_smiles(spark):
    df = spark.createDataFrame([(" \t x y  \x1c",), ("  ",), (None,)], "s string")
    rows = df.select(X.unicode_strip("s").alias("st"), X.extract_smiles_text("s").alias("smi")).collect()
    assert rows[0].st == "x y" and rows[0].smi == "y"
    assert rows[1].st == "" and rows[1].smi is None
    assert rows[2].smi is None


def test_task_and_negation(spark):
    df = spark.createDataFrame([("Task: BBBP",), ("BACE and bbbp",), ("toxic?",), ("other",)], "s string")
    got = [r.t for r in df.select(X.task_from_system("s").alias("t")).collect()]
    assert got == ["BBBP", "BBBP", "Clintox", "UNKNOWN_TASK"]
    st = spark.createDataFrame([("not improve",), ("Improved",), ("worse",)], "s string")
    assert [r.a for r in st.select(X.claim_status("s").alias("a")).collect()] == [1, 1, -1]
    assert [r.a for r in st.select(X.claim_status("s", negation_aware=True).alias("a")).collect()] == [-1, 1, -1]


def test_prompt_array_paths(spark):
    df = spark.createDataFrame([("Is it toxic?", "Predict M12 ")], "s string, u string")
    r = df.select(X.assemble_prompt("s", "u").alias("p")).select(
        X.extract_task("p").alias("t"), X.extract_smiles("p").alias("m")).first()
    assert r.t == "Clintox" and r.m == "M12"


def test_hostile_text_is_fast_and_whole(spark):
    import time
    bad = "<answer><name>" * 20000 + "x" * 100000
    df = spark.createDataFrame([(bad,)], "c string")
    t = time.time()
    r = df.select(X.extract_answer("c").alias("a"), X.reward_format("c").alias("f"),
                  X.reward_choice_count("c").alias("n"), F.size(X.parse_claims("c")).alias("k")).first()
    assert (r.a, r.f, r.n, r.k) == ("", -2.0, -1.5, 0)
    assert time.time() - t < 30
