"""Completion scoring: the four rewards, their total and the group advantage.

Physical plan (what ``score_completions`` asks Catalyst for):

1. Completion side, map-only: the text is searched once per completion and
   dropped before any shuffle (format/answer/choice rewards, claim array); the
   result is staged, with a number for every row.
2. The distinct claimed names are resolved to a vocabulary: a descriptor, its
   place among the values of a molecule and its range per name and task.
3. Prompt side: task and SMILES are projected from the prompt; the molecule's
   values arrive as one array of fixed length through one shuffle on ``smiles``
   (hot molecules are split by AQE's skew-join).
4. ``completions JOIN prompts USING (prompt_id)``: two bare shuffles whose result
   is not needed in their partitioning, so AQE can split a hot prompt.
5. Behind that join claims are exploded, meet the vocabulary (broadcast while it
   is small) and are scored as plain columns.  Rewards per completion are a hash
   aggregate of fixed-width sums over the rows of a completion, combined before
   its shuffle: what is shuffled is one narrow row per completion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chemscore.functions import text as X
from chemscore.operators.joins import DEFAULT_BROADCAST_ROWS, HOT_KEY_SALTS, lookup_join
from chemscore.operators.resolve import DEFAULT_CUTOFF, lasting_vocabulary, resolve_vocabulary
from chemscore.plans import dims
from chemscore.session import materialize


@dataclass(frozen=True)
class ScoreOptions:
    greedy: bool = False            # Q1: effective extractor is the lazy one
    exact: bool = False             # Q2: correctness is containment
    negation_aware: bool = False    # Q3: "not improve" counts as +1
    dotall: bool = False            # Q4: choice count only sees single-line name blocks
    min_number: int = 3
    max_number: int = 10
    cutoff: float = DEFAULT_CUTOFF  # Q6
    exact_first: bool = False       # Q10
    scope: str = "row"              # Q5: 'row' (default) or 'batch'
    task_name: str | None = None    # overrides the task that the prompts name
    weights: dict = field(default_factory=lambda: {"format": 1.0, "correctness": 1.0,
                                                   "choices": 1.0, "advantage": 1.0})
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    eps: float = 1e-4
    staging_dir: str | None = None  # overwrite-in-place staging (streams); default: unique tables
    vocabulary_dir: str | None = None   # a vocabulary that lasts over the micro-batches of a stream
    vocabulary_version: int = 0         # the micro-batch


# ----- inputs -------------------------------------------------------------------

def completion_text(df: DataFrame, col: str = "completion") -> Column:
    """Content of a completion given as STRING or ``ARRAY<STRUCT<role, content>>`` (element 0)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType):
        return F.coalesce(F.get(F.col(col), 0)["content"], F.lit(""))
    return F.coalesce(F.col(col), F.lit(""))


def prompt_fields(prompts: DataFrame) -> DataFrame:
    """(prompt_id, task, smiles, answer [, batch_id, pos]) from either a prompt
    array column ``prompt`` or the flattened ``system_content``/``user_content``."""
    cols = prompts.columns
    if "prompt" in cols:
        task = X.extract_task(F.col("prompt"))
        smiles = X.extract_smiles(F.col("prompt"))
    else:
        task = X.task_from_system(F.col("system_content"))
        smiles = X.extract_smiles_text(F.col("user_content"))
    extra = [c for c in ("batch_id", "pos") if c in cols]
    return prompts.select("prompt_id", task.alias("task"), smiles.alias("smiles"), "answer", *extra)


def batch_task(prompts: DataFrame, batch_col: str = "batch_id", pos_col: str = "pos",
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The task of the first prompt (by position) of each batch, for every prompt.

    ``min_by`` is a partial aggregate, so a huge batch never sits in one task.
    """
    p = prompt_fields(prompts)
    first = p.groupBy(batch_col).agg(F.min_by("task", pos_col).alias("batch_task"))
    return lookup_join(p, first, [batch_col], "left", max_broadcast_rows)


def descriptor_values(descriptors: DataFrame) -> DataFrame:
    """(smiles, desc ARRAY<DOUBLE>) from a wide or a long descriptor table: the
    values of ``dims.scorable_descriptors``, in their order.

    NULL values are failed computations (the claim is skipped).  Wide input needs
    no shuffle; long input is one partial aggregate per molecule.
    """
    names = dims.scorable_descriptors()
    if {"descriptor", "value"} <= set(descriptors.columns):
        return descriptors.groupBy("smiles").agg(F.array(*[
            F.max(F.when(F.col("descriptor") == n, F.col("value").cast("double"))) for n in names]).alias("desc"))
    held = set(descriptors.columns)
    return descriptors.select("smiles", F.array(*[
        F.col(n).cast("double") if n in held else F.lit(None).cast("double") for n in names]).alias("desc"))


def descriptors_long(descriptors_wide: DataFrame) -> DataFrame:
    """J4 input: unpivot every column but ``smiles``; NULL values dropped."""
    names = [c for c in descriptors_wide.columns if c != "smiles"]
    return (descriptors_wide.select("smiles", *[F.col(n).cast("double") for n in names])
            .unpivot("smiles", names, "descriptor", "value")
            .filter(F.col("value").isNotNull()))


def molecule_side(molecules: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(smiles, valid, desc, _values): one row per molecule.  Only values that a
    claim can ever be scored on are carried; ``_values`` is their hash."""
    dm = descriptor_values(descriptors).withColumn("_values", F.xxhash64("desc"))
    return (molecules.select("smiles", F.col("valid").cast("boolean").alias("valid"))
            .join(dm, "smiles", "left"))


def completion_features(completions: DataFrame, opts: ScoreOptions) -> DataFrame:
    """Per-completion projections (R1, X1, R3, X3); the text is dropped here."""
    # each cut is a column of its own, so that it is made once for all that is read off it
    texts = completions.select("prompt_id", "gen_idx", completion_text(completions).alias("_text"))
    texts = texts.withColumn("_name", X.after("_text", "<name>")).withColumn("_answer", X.after("_text", "<answer>"))
    texts = texts.withColumn("_block", X.before("_name", "</name>")).withColumn("_tail", X.after("_name", "</name>"))
    return texts.select(
        "prompt_id", "gen_idx",
        X.reward_format("_text", "_tail").alias("reward_format"),
        X.extract_answer("_text", opts.greedy, "_answer").alias("extracted"),
        X.reward_choice_count("_text", opts.min_number, opts.max_number, opts.dotall, "_block").alias("reward_choices"),
        X.raw_claims("_block").alias("claims"))


def aligned(feats: DataFrame, prompts: DataFrame, molecules: DataFrame, descriptors: DataFrame,
            opts: ScoreOptions) -> DataFrame:
    """J8 + J9: completions (``completion_features``) keyed to their prompt, molecule
    validity and descriptors.  Nothing above this join needs its partitioning,
    so AQE can broadcast a small side or split a hot prompt."""
    p = prompt_fields(prompts)
    if opts.scope == "batch":
        p = batch_task(prompts, max_broadcast_rows=opts.max_broadcast_rows).select(
            "prompt_id", F.col("batch_task").alias("task"), "smiles", "answer")
    else:
        p = p.select("prompt_id", "task", "smiles", "answer")
    if opts.task_name is not None:
        p = p.withColumn("task", F.lit(opts.task_name))
    p = p.join(molecule_side(molecules, descriptors), "smiles", "left")
    return feats.join(p, "prompt_id", "inner")


def prepare(completions: DataFrame, prompts: DataFrame, molecules: DataFrame, descriptors: DataFrame,
            opts: ScoreOptions) -> DataFrame:
    """Text work once: the per-completion features are written to the
    checkpoint folder (compact: the text is gone), then both the name
    vocabulary and the scoring read them.  One row per completion and claim
    (``score_claims``), one without a claim for a completion that makes none."""
    feats = completion_features(completions, opts).withColumn("_row", F.monotonically_increasing_id())
    feats = materialize(feats, "completion-features", opts.staging_dir)
    names = feats.select(F.explode("claims").alias("c")).select(X.raw_name("c").alias("_name")).distinct()
    names = materialize(names.withColumn("prop", X.unicode_strip("_name")), "claimed-names", opts.staging_dir)
    vocab = vocabulary(names, opts)
    base = aligned(feats, prompts, molecules, descriptors, opts)
    base = base.withColumn("reward_correctness", X.reward_correctness(F.col("extracted"), F.col("answer"), opts.exact)) \
        .withColumn("_claims", F.size("claims"))
    claims = base.select(*[c for c in base.columns if c != "claims"], F.posexplode_outer("claims").alias("claim_pos", "_claim"))
    claims = claims.withColumn("_name", X.raw_name("_claim")).withColumn("prop", X.unicode_strip("_name")) \
        .withColumn("norm", X.normalize_name("prop")) \
        .withColumn("label", F.when(F.col("_claim").isNotNull(), X.raw_label("_claim", opts.negation_aware)))
    return score_claims(named_claims(claims, names, vocab, opts))


# ----- claims ---------------------------------------------------------------------

def vocabulary(claim_rows: DataFrame, opts: ScoreOptions) -> DataFrame:
    """The (norm, task) -> descriptor table, written once to the checkpoint
    folder so the similarity UDF never re-runs and its size can be checked."""
    if opts.vocabulary_dir:
        return materialize(lasting_vocabulary(claim_rows, opts.vocabulary_dir, opts.vocabulary_version, "prop", opts.cutoff,
                                              opts.exact_first, staging_dir=opts.staging_dir), "vocabulary", opts.staging_dir)
    return materialize(resolve_vocabulary(claim_rows, "prop", opts.cutoff, opts.exact_first,
                                          staging_dir=opts.staging_dir)
                       .select("norm", "task", "descriptor", "stage", "matched_key", "ratio"),
                       "vocabulary", opts.staging_dir)


def claim_names(completions: DataFrame, opts: ScoreOptions) -> DataFrame:
    """Claimed property names straight from the completion text (no join needed)."""
    claims = X.parse_claims(completion_text(completions), opts.negation_aware)
    return completions.select(F.explode(claims).alias("c")).select(F.col("c.prop").alias("prop"))


def named_claims(claims: DataFrame, names: DataFrame, vocab: DataFrame, opts: ScoreOptions) -> DataFrame:
    """Claim rows with their name's ``descriptor`` for their task, its range (``lo``,
    ``hi``) and its place among a molecule's values (``_at``).  The join is on the
    name as it stands (``names``), which is normalized once and not per claim."""
    spark, values = vocab.sparkSession, dims.scorable_descriptors()
    at = F.array_position(F.array(*[F.lit(n) for n in values]), F.col("descriptor"))
    keys = names.select("_name", X.normalize_name("prop").alias("norm"))
    known = (vocab.filter(F.col("descriptor").isNotNull()).select("norm", "task", "descriptor")
             .join(F.broadcast(dims.ranges_df(spark)), ["task", "descriptor"], "left")
             .join(keys, "norm")
             .select("_name", "task", "descriptor", "lo", "hi", F.when(at > 0, at - 1).cast("int").alias("_at")))
    # a handful of names carry most claims: salt if the vocabulary is too big to broadcast
    return lookup_join(claims, materialize(known, "vocabulary-by-name", opts.staging_dir), ["_name", "task"], "left",
                       opts.max_broadcast_rows, salts=HOT_KEY_SALTS, salt_by=["_row", "claim_pos"], stage=False)


def score_claims(claims: DataFrame) -> DataFrame:
    """``value``, ``range_label``, ``agreement`` and ``claim_status`` (why a
    claim is not scored; its agreement is NULL then) of every claim row."""
    status = (F.when(F.col("claim_pos").isNull(), F.lit("no_claims"))
              .when(F.col("smiles").isNull(), F.lit("no_smiles"))
              .when(~F.coalesce(F.col("valid"), F.lit(False)), F.lit("invalid_molecule"))
              .when(F.col("task") == dims.UNKNOWN_TASK, F.lit("unknown_task"))
              .when(F.col("descriptor").isNull(), F.lit("no_match"))
              .when(F.col("_at").isNull() | F.col("lo").isNull(), F.lit("no_function_or_range"))
              .when(F.col("value").isNull(), F.lit("no_value"))
              .otherwise(F.lit("scored")))
    rows = claims.withColumn("value", F.get("desc", F.col("_at"))).withColumn("claim_status", status)
    inside = F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(1)).otherwise(F.lit(-1))
    rows = rows.withColumn("range_label", F.when(F.col("claim_status") == "scored", inside))
    return rows.withColumn("agreement", F.abs(F.col("label") + F.col("range_label")) / F.lit(2.0))


def claim_detail(base: DataFrame, keep_unclaimed: bool = True) -> DataFrame:
    """R4 (+P8) in row form: one row per claim; completions without claims keep
    one row with NULL claim (status ``no_claims``) when ``keep_unclaimed``."""
    rows = base if keep_unclaimed else base.filter(F.col("claim_pos").isNotNull())
    return rows.drop("_row", "_claim", "_claims", "_name", "_at", "_values", "reward_correctness")


def claim_rows(completions: DataFrame, prompts: DataFrame, molecules: DataFrame, descriptors: DataFrame,
               opts: ScoreOptions | None = None, keep_unclaimed: bool = True) -> DataFrame:
    """``claim_detail`` of the prepared completions."""
    return claim_detail(prepare(completions, prompts, molecules, descriptors, opts or ScoreOptions()), keep_unclaimed)


# ----- per completion and per prompt -------------------------------------------------

def per_completion(base: DataFrame, opts: ScoreOptions) -> DataFrame:
    """R5 + P5 + R2 + R6: one row per completion and prompt row (``prepare``).

    A completion's rows are told by the number it got when it was staged, and by
    everything of its prompt that bears on the result.  Prompt rows that are alike
    in that share a group, and leave it as often as they went in.  The prompt's
    key is not a grouping key by itself: grouping on the join's own partitioning
    would keep AQE from splitting a hot prompt.
    """
    w = opts.weights
    place = (F.when(F.col("smiles").isNull(), F.lit("no_smiles"))
             .when(~F.coalesce(F.col("valid"), F.lit(False)), F.lit("invalid_molecule"))
             .when(F.col("task") == dims.UNKNOWN_TASK, F.lit("unknown_task")))
    rewards = ["reward_format", "reward_correctness", "reward_choices"]
    sums = base.withColumn("_place", place).groupBy(
        "_row", F.struct("prompt_id", "gen_idx").alias("_ids"), "task", *rewards, "_claims", "_place", "_values").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("agreement").alias("_scored"), F.sum("agreement").alias("_agreed"))
    sums = sums.withColumn("_times", (F.col("_rows") / F.greatest(F.col("_claims"), F.lit(1))).cast("int"))
    rows = sums.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy"))
    reason = (F.when(F.col("_claims") == 0, F.lit("no_claims")).when(F.col("_place").isNotNull(), F.col("_place"))
              .when(F.col("_scored") == 0, F.lit("none_scorable")).otherwise(F.lit("scored")))
    out = rows.select(
        "_ids.prompt_id", "_ids.gen_idx", "task", *rewards,
        F.when(F.col("_scored") > 0, F.col("_agreed") / F.col("_scored")).otherwise(F.lit(0.0)).alias("reward_advantage"),
        reason.alias("skip_reason"), F.col("_claims").cast("long").alias("n_claims"),
        (F.col("_scored") / F.col("_times")).cast("long").alias("n_scored"))
    total = (F.lit(float(w.get("format", 1.0))) * F.col("reward_format")
             + F.lit(float(w.get("correctness", 1.0))) * F.col("reward_correctness")
             + F.lit(float(w.get("choices", 1.0))) * F.col("reward_choices")
             + F.lit(float(w.get("advantage", 1.0))) * F.col("reward_advantage"))
    return out.withColumn("reward_total", total)


def group_advantage(scored: DataFrame, reward_col: str = "reward_total", group_col: str = "prompt_id",
                    eps: float = 1e-4, staging_dir: str | None = None, stage: bool = True) -> DataFrame:
    """(reward - group mean) / (group sample std + eps) over the generation
    group of each prompt.

    The group statistics are partial aggregates (map-side combine), joined
    back on the group key.  Both sides are staged first: the scoring plan runs
    once, and the join is over two bare shuffles, so AQE's skew join can split
    a group that holds a large share of all rows.
    """
    if stage:
        scored = materialize(scored, "scored-completions", staging_dir)
    stats = scored.groupBy(group_col).agg(F.avg(reward_col).alias("group_mean"),
                                          F.stddev_samp(reward_col).alias("group_std"),
                                          F.count(F.lit(1)).alias("group_size"))
    out = scored.join(materialize(stats, "group-statistics", staging_dir), group_col, "inner")
    return out.withColumn("advantage", (F.col(reward_col) - F.col("group_mean"))
                          / (F.coalesce(F.col("group_std"), F.lit(0.0)) + F.lit(eps)))


def score_completions(completions: DataFrame, prompts: DataFrame, molecules: DataFrame,
                      descriptors: DataFrame, opts: ScoreOptions | None = None,
                      with_group_advantage: bool = True) -> DataFrame:
    """The whole scoring job: rewards R1-R6 per completion, then R7."""
    opts = opts or ScoreOptions()
    scored = per_completion(prepare(completions, prompts, molecules, descriptors, opts), opts)
    return group_advantage(scored, eps=opts.eps, staging_dir=opts.staging_dir) if with_group_advantage else scored


def reward_summary(scored: DataFrame) -> DataFrame:
    """Per reward and task: count, mean, sample std, min, max; with rollup totals."""
    names = ["reward_format", "reward_correctness", "reward_choices", "reward_advantage", "reward_total"]
    long = scored.select("task", *names).unpivot("task", names, "reward", "value")
    return long.rollup("reward", "task").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
