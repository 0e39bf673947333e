"""F1 reward registry (built-ins + a user pandas_udf reward) and array-form completions."""

import pytest
from pyspark.sql import functions as F

from chemscore.functions.registry import apply_rewards, builtin_rewards, function_reward, python_reward, text_rewards
from chemscore.operators import rewards as R
from chemscore.plans.views import view

from fixtures_core import SF001


def test_registry_with_python_reward(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def length_bonus(s: pd.Series) -> pd.Series:
        return (s.str.len() > 40).astype("float64")

    df = spark.createDataFrame([("<name>a:improve,b:x,c:y</name> <answer>True</answer>", "True"),
                                ("<answer>no</answer>", "True")], "completion string, answer string")
    rw = dict(text_rewards())
    rw["length"] = lambda d: length_bonus(F.col("completion"))
    out = apply_rewards(df, rw, weights={"length": 0.5}).collect()
    assert [r.reward_format for r in out] == [1.0, -2.0]
    assert [r.reward_correctness for r in out] == [2.0, 0.0]
    assert [r.reward_choices for r in out] == [0.0, -1.5]
    assert [r.reward_total for r in out] == [1.0 + 2.0 + 0.0 + 0.5, -2.0 + 0.0 - 1.5 + 0.0]


def test_all_four_rewards_sum_up(spark):
    frames = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    scored = R.score_completions(*frames, with_group_advantage=False)
    rewards = {**builtin_rewards(), "claims": python_reward("n_claims", float)}
    out = apply_rewards(scored.withColumnRenamed("reward_total", "want"), rewards, {"claims": 0.0})
    assert out.where("abs(reward_total - want) > 1e-12 or reward_claims <> n_claims").count() == 0


def test_array_form_completions_score_the_same(spark):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    arr = c.select("prompt_id", "gen_idx", F.array(F.struct(F.lit("assistant").alias("role"),
                                                             F.col("completion").alias("content"))).alias("completion"))
    a = R.score_completions(arr, p, m, d, with_group_advantage=False).select("prompt_id", "gen_idx", "reward_total")
    b = R.score_completions(c, p, m, d, with_group_advantage=False).select("prompt_id", "gen_idx", "reward_total")
    assert sorted(a.collect()) == sorted(b.collect())


def test_function_reward_takes_what_a_trainer_gives(spark):
    def says_answer(prompts, completions, answer):
        assert len(prompts) == len(completions) == len(answer)
        return [None if a is None else float(a in c[0]["content"]) + 10 * len(p) for p, c, a in zip(prompts, completions, answer)]

    rows = [(i, [("system", "s"), ("user", "u")][:1 + i % 2], [("assistant", f"it is {i}")], None if i == 4 else str(i % 3)) for i in range(7)]
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(rows, f"i long, prompt {message}, completion {message}, answer string")
    reward = function_reward(says_answer, prompts="prompt", completions="completion", answer="answer")
    out = apply_rewards(df, {"says": reward}, {"says": 2.0})
    got = {r.i: (r.reward_says, r.reward_total) for r in out.collect()}
    want = {i: float(str(i % 3) in f"it is {i}") + 10 * (1 + i % 2) for i in range(7) if i != 4}
    assert got == {**{i: (v, 2 * v) for i, v in want.items()}, 4: (None, None)}
    short = function_reward(lambda answer: answer[1:], answer="i")
    with pytest.raises(Exception, match="numbers for"):
        apply_rewards(df, {"short": short}).collect()
