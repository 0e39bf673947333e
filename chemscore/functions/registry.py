"""the reward-function surface.

A reward is ``Callable[[DataFrame], Column]``: given the per-completion
feature frame it returns a DOUBLE column.  Built-in rewards are Column
expressions; a Python reward is a function of one column (``python_reward``) or
of prompts, completions and answers (``function_reward``), run on Arrow batches.  ``total`` sums the registered rewards with weights (default 1.0).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemscore.functions import text as X

Reward = Callable[[DataFrame], Column]


def builtin_rewards() -> dict[str, Reward]:
    """The four rewards over the columns of ``operators.rewards.per_completion``
    (the texts are scored there, before any join; the advantage reward needs
    the joins)."""
    return {
        "format": lambda df: F.col("reward_format"),
        "correctness": lambda df: F.col("reward_correctness"),
        "choices": lambda df: F.col("reward_choices"),
        "advantage": lambda df: F.col("reward_advantage"),
    }


def text_rewards(text_col: str = "completion", answer_col: str = "answer") -> dict[str, Reward]:
    """The three text rewards straight over a frame with the text and the answer."""
    return {
        "format": lambda df: X.reward_format(F.col(text_col)),
        "correctness": lambda df: X.reward_correctness(X.extract_answer(F.col(text_col)), F.col(answer_col)),
        "choices": lambda df: X.reward_choice_count(F.col(text_col)),
    }


def python_reward(column: str, fn: Callable[[object], float]) -> Reward:
    """A Python function of one column as an Arrow-batched reward."""
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn).astype("float64")

    return lambda df: run(F.col(column))


def _plain(value: object) -> object:
    """Arrays and structs of an Arrow batch as lists and dictionaries."""
    if isinstance(value, (list, tuple, np.ndarray)) and not hasattr(value, "asDict"):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        value = value.asDict()
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def function_reward(fn: Callable[..., Sequence[float]], **columns: str) -> Reward:
    """A trainer's reward function as it is: ``fn`` gets one list per argument,
    aligned over a batch of completions, and gives one number each, as in
    ``function_reward(f, prompts="prompt", completions="completion", answer="answer")``.

    Batches are Arrow batches, so ``fn`` must not look beyond its rows; message
    arrays come as lists of dictionaries.  A result of another length fails the
    job; a missing number is NULL."""
    names = list(columns)

    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        got = list(fn(**{n: [_plain(v) for v in s] for n, s in zip(names, values, strict=True)}))
        if len(got) != len(values[0]):
            raise ValueError(f"the reward function gave {len(got)} numbers for {len(values[0])} completions")
        return pd.Series(got, dtype="float64")

    return lambda df: run(*[F.col(c) for c in columns.values()])


def apply_rewards(df: DataFrame, rewards: dict[str, Reward], weights: dict[str, float] | None = None,
                  prefix: str = "reward_", total: str = "reward_total") -> DataFrame:
    """Add one column per reward and their weighted sum."""
    weights = weights or {}
    out = df
    for name, fn in rewards.items():
        out = out.withColumn(prefix + name, fn(out).cast("double"))
    s = None
    for name in rewards:
        term = F.lit(float(weights.get(name, 1.0))) * F.col(prefix + name)
        s = term if s is None else s + term
    return out.withColumn(total, s if s is not None else F.lit(0.0))
