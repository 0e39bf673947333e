"""Scoring job: hand-made cases, options, skew, properties (the fixture is held against SQL in test_entry)."""

import math

import pytest
from pyspark.sql import functions as F

from chemscore.operators import rewards as R
from chemscore.plans import dims
from chemscore.plans.views import view

from fixtures_core import SF001


# A hand-made case: three molecules, one prompt per task, expected rewards worked out by hand from the
# range table (BBBP: MolWt, MolLogP and TPSA have ranges; a claim agrees if "improve" meets a value in range).
PROMPTS = [(1, "Task: BBBP", "what about M1", "True"), (2, "Task: BBBP", "what about M2", "True"),
           (3, "Task: BBBP", "what about M3", "False"), (4, "some chemistry", "what about M1", "True"),
           (5, "Task: BBBP", "  ", "True")]
MOLECULES = [("M1", True), ("M2", True), ("M3", False)]


def _in_and_out(descriptor):
    lo, hi = next((lo, hi) for t, d, lo, hi in dims.range_rows() if (t, d) == ("BBBP", descriptor))
    return float(lo), float(hi) + 1.0


BLOCK = "<name>{}</name><answer>{}</answer>"
# prompt, text, (format, correctness, choices, advantage), why
CASES = [
    (1, BLOCK.format("MolWt: improve, MolLogP: improve, TPSA: improve", "True"), (1.0, 2.0, 0.0, 1.0), "scored"),
    (1, BLOCK.format("MolWt: improve, MolLogP: worse, TPSA: worse", "False"), (1.0, 0.0, 0.0, 1 / 3), "scored"),
    (2, BLOCK.format("MolWt: improve, MolLogP: improve, TPSA: worse", "it is True"), (1.0, 2.0, 0.0, 1 / 3), "scored"),
    (2, BLOCK.format("MolWt: worse, MolLogP: worse", "True") + " <answer>x</answer>", (1.0, 2.0, -1.0, 1.0), "scored"),
    (2, "<name>MolWt: not improve</name> so <answer>True</answer>", (-2.0, 2.0, -1.0, 0.0), "scored"),
    (3, BLOCK.format("MolWt: improve", "False"), (1.0, 2.0, -1.0, 0.0), "invalid_molecule"),
    (4, BLOCK.format("MolWt: improve", "True"), (1.0, 2.0, -1.0, 0.0), "unknown_task"),
    (5, BLOCK.format("MolWt: improve", "True"), (1.0, 2.0, -1.0, 0.0), "no_smiles"),
    (1, "<answer>True</answer>", (-2.0, 2.0, -1.5, 0.0), "no_claims"),
    (1, "", (-2.0, 0.0, -1.5, 0.0), "no_claims"),
]


def _case_frames(spark):
    good, bad = zip(*(_in_and_out(d) for d in ("MolWt", "MolLogP", "TPSA")))
    # M1 is in range everywhere; M2 is out of range but for TPSA, which it lacks in range too
    return (spark.createDataFrame([(p, i, t) for i, (p, t, _, _) in enumerate(CASES)], "prompt_id long, gen_idx long, completion string"),
            spark.createDataFrame(PROMPTS, "prompt_id long, system_content string, user_content string, answer string"),
            spark.createDataFrame(MOLECULES, "smiles string, valid boolean"),
            spark.createDataFrame([("M1", *good), ("M2", *bad), ("M3", *good)],
                                  "smiles string, MolWt double, MolLogP double, TPSA double"))


def _check(rows, want):
    assert len(rows) == len(CASES)
    for r in rows:
        f, c, n, a, why = want(r.gen_idx)
        assert (r.reward_format, r.reward_correctness, r.reward_choices, r.skip_reason) == (f, c, n, why), r
        assert math.isclose(r.reward_advantage, a, abs_tol=1e-12), r
        assert math.isclose(r.reward_total, f + c + n + a, abs_tol=1e-12), r


def test_hand_made_cases(spark):
    rows = R.score_completions(*_case_frames(spark), with_group_advantage=False).collect()
    _check(rows, lambda i: (*CASES[i][2], CASES[i][3]))


def test_options_on_hand_made_cases(spark):
    opts = R.ScoreOptions(greedy=True, negation_aware=True, dotall=True, exact=True)
    rows = R.score_completions(*_case_frames(spark), opts, with_group_advantage=False).collect()
    changed = {2: (1.0, 0.0, 0.0, 1 / 3, "scored"),            # exact: "it is True" is not "True"
               3: (1.0, 0.0, -1.0, 1.0, "scored"),             # greedy: the answer runs to the last tag
               4: (-2.0, 2.0, -1.0, 1.0, "scored")}            # "not improve" is a claim of no improvement
    _check(rows, lambda i: changed.get(i, (*CASES[i][2], CASES[i][3])))


def test_task_override(spark):
    rows = R.score_completions(*_case_frames(spark), R.ScoreOptions(task_name="BBBP"), with_group_advantage=False).collect()
    _check(rows, lambda i: (1.0, 2.0, -1.0, 1.0, "scored") if i == 6 else (*CASES[i][2], CASES[i][3]))


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_prompt_is_split(spark):
    """One prompt holds a third of all completions: both joins on prompt_id split it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            # a staged file is a map task of its own, as files beyond a split's size are; packed into one task by
            # their open cost, the hot rows would be one map output, which cannot be split
            "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    _, p, m, d = _case_frames(spark)
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).cast("long").alias("prompt_id"),
        F.col("id").alias("gen_idx"),
        F.concat(F.lit("<name>MolWt: improve, n"), F.col("id").cast("string"), F.lit(": worse</name><answer>"),
                 F.sha2(F.col("id").cast("string"), 256), F.lit("</answer>")).alias("completion"))
    prompts = p.unionByName(spark.range(10, 30_010).select(
        F.col("id").alias("prompt_id"), F.lit("Task: BBBP").alias("system_content"), F.lit("q M1").alias("user_content"),
        F.lit("True").alias("answer")))
    # names are resolved by distinct name: keep the similarity work of this test small
    many = many.withColumn("completion", F.regexp_replace("completion", "n[0-9]+:", "TPSA:"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        base = R.prepare(many, prompts, m, d, R.ScoreOptions())
        scored = R.per_completion(base, R.ScoreOptions())
        assert "skew=true" in _final_plan(scored)
        out = R.group_advantage(scored)
        assert "skew=true" in _final_plan(out)
        got = out.agg(F.count("*").alias("n"), F.sum("advantage").alias("s")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got.n == 30_000 and abs(got.s) < 1e-6


@pytest.fixture(scope="module")
def scored_small(spark):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    return R.score_completions(c, p, m, d).collect()


def test_properties(scored_small):
    groups = {}
    for r in scored_small:
        assert 0.0 <= r.reward_advantage <= 1.0
        assert -3.5 <= r.reward_total <= 4.0
        groups.setdefault(r.prompt_id, []).append(r.advantage)
    for advs in groups.values():
        assert abs(sum(advs)) < 1e-6


def test_batch_scope_and_options(spark):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    pb = p.withColumn("batch_id", F.floor(F.col("prompt_id") / 4).cast("long")).withColumn("pos", F.col("prompt_id"))
    a = R.score_completions(c, pb, m, d, R.ScoreOptions(scope="batch"), with_group_advantage=False)
    b = R.score_completions(c, p, m, d, R.ScoreOptions(), with_group_advantage=False)
    assert a.count() == b.count()
    # the batch task is the task of the batch's first prompt
    bt = R.batch_task(pb).collect()
    first = {}
    for r in sorted(bt, key=lambda r: r.prompt_id):
        first.setdefault(r.batch_id, r.task)
    assert all(r.batch_task == first[r.batch_id] for r in bt)


def test_salted_lookup_join_equals_broadcast(spark):
    from chemscore.operators.joins import lookup_join
    big = spark.range(0, 5000).select((F.col("id") % 7).alias("k"), F.col("id"))
    dim = spark.range(0, 7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    a = sorted(lookup_join(big, dim, ["k"], "left").collect())
    b = sorted(lookup_join(big, dim, ["k"], "left", max_broadcast_rows=0, salts=4).collect())
    c = sorted(lookup_join(big, dim, ["k"], "left", max_broadcast_rows=0).collect())
    assert a == b == c


def test_duplicate_claim_keeps_advantage_in_range(spark):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    dup = c.withColumn("completion", F.regexp_replace("completion", "</name>", ", LogP: improve, LogP: improve</name>"))
    out = R.score_completions(dup, p, m, d, with_group_advantage=False)
    row = out.agg(F.min("reward_advantage").alias("lo"), F.max("reward_advantage").alias("hi"),
                  F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= row.lo and row.hi <= 1.0 and row.n == c.count()


def test_long_and_wide_descriptors_score_alike(spark):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    long = R.descriptors_long(d)
    long = long.unionByName(long)  # duplicated rows must not change anything
    a = R.score_completions(c, p, m, long, with_group_advantage=False).select("prompt_id", "gen_idx", "reward_advantage")
    b = R.score_completions(c, p, m, d, with_group_advantage=False).select("prompt_id", "gen_idx", "reward_advantage")
    assert sorted(a.collect()) == sorted(b.collect())


def test_claim_rows_equal_the_gathered_form(spark):
    frames = [view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide")]
    for keep in (True, False):
        want = R.claim_detail(R.prepare(*frames, R.ScoreOptions()), keep)
        got = R.claim_rows(*frames, keep_unclaimed=keep)
        assert set(got.columns) == set(want.columns)
        cols = sorted(c for c in got.columns if c != "desc")
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_rows_with_repeated_keys_are_scored_one_by_one(spark):
    """A completion whose key comes again keeps its own claims; every prompt row that fits gives a row."""
    c, p, m, d = _case_frames(spark)
    c = c.withColumn("gen_idx", F.lit(0).cast("long"))                       # all completions of a prompt share a key
    p = p.unionByName(p).unionByName(spark.createDataFrame([(1, "Task: BACE", "what about M3", "True")], p.schema))
    got = R.score_completions(c, p, m, d, with_group_advantage=False).groupBy("prompt_id", "task", "skip_reason").agg(
        F.count("*").alias("n"), F.sum("n_claims").alias("claims"), F.sum("n_scored").alias("scored")).collect()
    got = {(r.prompt_id, r.task, r.skip_reason): (r.n, r.claims, r.scored) for r in got}
    assert got == {(1, "BBBP", "scored"): (4, 12, 12), (1, "BBBP", "no_claims"): (4, 0, 0),
                   (1, "BACE", "invalid_molecule"): (2, 6, 0), (1, "BACE", "no_claims"): (2, 0, 0),
                   (2, "BBBP", "scored"): (6, 12, 12), (3, "BBBP", "invalid_molecule"): (2, 2, 0),
                   (4, "UNKNOWN_TASK", "unknown_task"): (2, 2, 0), (5, "BBBP", "no_smiles"): (2, 2, 0)}


def test_claims_are_scored_as_columns(spark):
    """Claims are neither gathered into arrays nor scored by functions over arrays; names are normalized once each."""
    frames = [view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide")]
    plans = [_final_plan(df) for df in (R.score_completions(*frames, with_group_advantage=False), R.claim_rows(*frames).select("agreement"))]
    for plan in plans:
        assert not any(x in plan for x in ("collect_list", "lambdafunction", "ObjectHashAggregate", "translate("))
