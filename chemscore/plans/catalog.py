"""The query registry behind ``__spark_entry__.queries()``.

Every query takes ``(spark, sf_dir)``, reads the base tables of that folder
(directly or through the derived views of ``plans.views``) in full, and
returns a lazy DataFrame.  Computed columns carry the same names as in the
DuckDB oracles (``plans.oracles``); doubles that come out of averages or
divisions are rounded to 6 places on both sides, integers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore.functions import text as X
from chemscore.operators import rewards as R
from chemscore.plans import dims
from chemscore.plans.views import view
from chemscore.sources import records as S
from chemscore.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ----- shared inputs ---------------------------------------------------------------

def scoring_inputs(spark, sf):
    return (view(spark, sf, "completions"), view(spark, sf, "prompts"),
            view(spark, sf, "molecules"), view(spark, sf, "descriptors_wide"))


def scored(spark, sf, opts: R.ScoreOptions | None = None, group: bool = True) -> DataFrame:
    c, p, m, d = scoring_inputs(spark, sf)
    return R.score_completions(c, p, m, d, opts or R.ScoreOptions(), with_group_advantage=group)


def claim_rows(spark, sf, opts: R.ScoreOptions | None = None, keep_unclaimed: bool = False) -> DataFrame:
    opts = opts or R.ScoreOptions()
    c, p, m, d = scoring_inputs(spark, sf)
    return R.claim_rows(c, p, m, d, opts, keep_unclaimed)


def part_text(spark, sf) -> DataFrame:
    """Text built from part names: half carry ``####`` sections, all carry
    padding of Unicode whitespace."""
    p = table(spark, sf, "part")
    hashed = F.concat(F.col("p_name"), F.lit(" #### "), F.col("p_brand"), F.lit(" #### "), F.col("p_type"))
    return p.select("p_partkey", "p_name", "p_brand",
                    F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(hashed).alias("txt"),
                    F.concat(F.lit("\n \u00a0"), F.col("p_name"), F.lit("\t\x1c\u2003")).alias("padded"))


def order_json(spark, sf) -> DataFrame:
    """A two-element JSON array per order; the first ``output`` is a boolean,
    a string or null, the second a string."""
    o = table(spark, sf, "orders")
    first_out = (F.when(F.col("o_orderkey") % 3 == 0,
                        F.when(F.col("o_custkey") % 2 == 0, F.lit("true")).otherwise(F.lit("false")))
                 .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')))
                 .otherwise(F.lit("null")))
    txt = F.concat(F.lit('[{"instruction":"'), F.col("o_orderpriority"), F.lit('","input":"SMILES M'),
                   F.col("o_orderkey").cast("string"), F.lit('","output":'), first_out,
                   F.lit('},{"instruction":"'), F.col("o_orderstatus"), F.lit('","input":"'),
                   F.col("o_orderpriority"), F.lit('","output":"'), F.col("o_orderpriority"), F.lit('"}]'))
    return o.select("o_orderkey", txt.alias("js"))


# ----- S1, P1, P2 -----------------------------------------------------------------------

@query("json_array_records")
def q_json_array_records(spark, sf):
    rec = S.records_from_column(order_json(spark, sf), "js", keep=("o_orderkey",))
    return rec.select("o_orderkey", F.col("idx").cast("bigint").alias("idx"), "instruction", "input",
                      S.answer_to_string(F.col("output")).alias("answer"))


@query("answer_to_string")
def q_answer_to_string(spark, sf):
    rec = S.records_from_column(order_json(spark, sf), "js", keep=("o_orderkey",))
    return S.to_samples(rec, keep=("o_orderkey", "idx")).select(
        "o_orderkey", F.col("idx").cast("bigint").alias("idx"), "answer")


@query("assemble_prompt")
def q_assemble_prompt(spark, sf):
    """P1 over one-row-per-turn conversations: the first system and the first
    user message (by turn) form the two-message prompt; X6 reads its task.
    ``min_by`` is a partial aggregate, so even a huge conversation is reduced
    map-side and never collected whole."""
    conv = table(spark, sf, "conversations")
    msg = F.struct("turn", "text")
    first = conv.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "system", msg), F.when(F.col("role") == "system", F.col("turn"))).alias("sys"),
        F.min_by(F.when(F.col("role") == "user", msg), F.when(F.col("role") == "user", F.col("turn"))).alias("usr"),
        F.count(F.lit(1)).alias("n_messages"))
    prompt = X.assemble_prompt(F.col("sys.text"), F.col("usr.text"))
    prompt = F.filter(prompt, lambda m: m["content"].isNotNull())
    return first.select("conv_id", "n_messages", F.size(prompt).cast("bigint").alias("prompt_len"),
                        X.extract_task(prompt).alias("task"),
                        F.length(F.col("usr.text")).cast("bigint").alias("user_chars"))


# ----- X1-X10 ---------------------------------------------------------------------------

def _per_completion(spark, sf, col, name):
    c = view(spark, sf, "completions")
    return c.select("prompt_id", "gen_idx", col(F.col("completion")).alias(name))


@query("extract_answer")
def q_extract_answer(spark, sf):
    return _per_completion(spark, sf, lambda c: X.extract_answer(c), "answer_text")


@query("extract_answer_greedy")
def q_extract_answer_greedy(spark, sf):
    return _per_completion(spark, sf, lambda c: X.extract_answer(c, greedy=True), "answer_text")


@query("extract_name_block")
def q_extract_name_block(spark, sf):
    return _per_completion(spark, sf, X.extract_name_block, "name_block")


@query("parse_claims")
def q_parse_claims(spark, sf):
    c = view(spark, sf, "completions")
    return c.select("prompt_id", "gen_idx", F.posexplode(X.parse_claims("completion")).alias("pos", "claim")) \
        .select("prompt_id", "gen_idx", F.col("pos").cast("bigint").alias("pos"),
                F.col("claim.prop").alias("prop"), F.col("claim.label").cast("bigint").alias("label"))


@query("claim_status")
def q_claim_status(spark, sf):
    c = view(spark, sf, "completions")
    return c.select("prompt_id", "gen_idx", F.posexplode(X.claim_pairs("completion")).alias("pos", "claim")) \
        .select("prompt_id", "gen_idx", F.col("pos").cast("bigint").alias("pos"),
                F.col("claim.status").alias("status"),
                X.claim_status(F.col("claim.status")).cast("bigint").alias("label"),
                X.claim_status(F.col("claim.status"), negation_aware=True).cast("bigint").alias("label_negation_aware"))


@query("claim_filters")
def q_claim_filters(spark, sf):
    c = view(spark, sf, "completions")
    return c.select("prompt_id", "gen_idx",
                    F.size(X.claim_items("completion")).cast("bigint").alias("n_items"),
                    F.size(X.claim_pairs("completion")).cast("bigint").alias("n_claims"))


@query("normalize_name")
def q_normalize_name(spark, sf):
    names = R.claim_names(view(spark, sf, "completions"), R.ScoreOptions()).distinct()
    return names.select("prop", X.normalize_name("prop").alias("norm"))


@query("extract_task")
def q_extract_task(spark, sf):
    p = view(spark, sf, "prompts")
    prompt = X.assemble_prompt("system_content", "user_content")
    return p.select("prompt_id", X.extract_task(prompt).alias("task"))


@query("extract_smiles")
def q_extract_smiles(spark, sf):
    p = view(spark, sf, "prompts")
    prompt = X.assemble_prompt("system_content", "user_content")
    return p.select("prompt_id", X.extract_smiles(prompt).alias("smiles"))


@query("extract_hash_answer")
def q_extract_hash_answer(spark, sf):
    return part_text(spark, sf).select("p_partkey", X.extract_hash_answer("txt").alias("hash_answer"))


@query("format_template")
def q_format_template(spark, sf):
    return part_text(spark, sf).select("p_partkey", X.format_template("p_name", "p_brand").alias("formatted"))


@query("unicode_strip")
def q_unicode_strip(spark, sf):
    t = part_text(spark, sf)
    return t.select("p_partkey", X.unicode_strip("padded").alias("stripped"),
                    F.trim(F.col("padded")).alias("spark_trimmed"))


# ----- R1-R3 and friends -------------------------------------------------------------

@query("reward_format")
def q_reward_format(spark, sf):
    return _per_completion(spark, sf, X.reward_format, "reward_format")


@query("reward_correctness")
def q_reward_correctness(spark, sf):
    c, p, _, _ = scoring_inputs(spark, sf)
    j = c.select("prompt_id", "gen_idx", X.extract_answer("completion").alias("ext")) \
        .join(p.select("prompt_id", "answer"), "prompt_id")
    return j.select("prompt_id", "gen_idx", X.reward_correctness("ext", "answer").alias("reward_correctness"),
                    X.reward_correctness("ext", "answer", exact=True).alias("reward_exact"))


@query("reward_choice_count")
def q_reward_choice_count(spark, sf):
    c = view(spark, sf, "completions")
    return c.select("prompt_id", "gen_idx", X.reward_choice_count("completion").alias("reward_choices"),
                    X.reward_choice_count("completion", dotall=True).alias("reward_choices_dotall"))


@query("answer_accuracy")
def q_answer_accuracy(spark, sf):
    """Exact equality of stripped extracted answer and stripped label."""
    c, p, _, _ = scoring_inputs(spark, sf)
    j = c.select("prompt_id", X.extract_answer("completion").alias("pred")) \
        .join(p.select("prompt_id", "answer"), "prompt_id")
    hit = (X.unicode_strip("pred") == X.unicode_strip("answer")).cast("double")
    return j.agg(r6(F.coalesce(F.avg(hit), F.lit(0.0))).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))


# ----- joins ------------------------------------------------------------------------------

@query("align_by_key")
def q_align_by_key(spark, sf):
    c, p, _, _ = scoring_inputs(spark, sf)
    pf = R.prompt_fields(p)
    return c.select("prompt_id", "gen_idx").join(pf, "prompt_id", "inner") \
        .select("prompt_id", "gen_idx", "task", "smiles", "answer")


@query("invalid_molecules")
def q_invalid_molecules(spark, sf):
    _, p, m, _ = scoring_inputs(spark, sf)
    pf = R.prompt_fields(p).filter(F.col("smiles").isNotNull())
    valid = m.filter(F.col("valid")).select("smiles")
    return pf.join(valid, "smiles", "left_anti").select("prompt_id", "smiles")


@query("alias_lookup_join")
def q_alias_lookup_join(spark, sf):
    c = view(spark, sf, "completions")
    cl = c.select("prompt_id", "gen_idx", F.posexplode(X.parse_claims("completion")).alias("pos", "claim")) \
        .select("prompt_id", "gen_idx", F.col("pos").cast("bigint").alias("pos"),
                X.normalize_name(F.col("claim.prop")).alias("alias"))
    return cl.join(F.broadcast(dims.alias_df(spark)), "alias", "left") \
        .select("prompt_id", "gen_idx", "pos", "alias", "descriptor")


@query("registry_resolve")
def q_registry_resolve(spark, sf):
    c = view(spark, sf, "completions")
    cl = c.select("prompt_id", "gen_idx", F.posexplode(X.parse_claims("completion")).alias("pos", "claim")) \
        .select("prompt_id", "gen_idx", F.col("pos").cast("bigint").alias("pos"),
                X.normalize_name(F.col("claim.prop")).alias("key"))
    reg = F.broadcast(dims.registry_df(spark).select("key", F.col("descriptor").alias("canonical"), "is_function"))
    return cl.join(reg, "key", "left").select("prompt_id", "gen_idx", "pos", "key", "canonical", "is_function")


def _claims_out(df, *cols):
    return df.select("prompt_id", "gen_idx", F.col("claim_pos").cast("bigint").alias("pos"), *cols)


@query("resolve_property")
def q_resolve_property(spark, sf):
    opts = R.ScoreOptions()
    return R.vocabulary(R.claim_names(view(spark, sf, "completions"), opts), opts) \
        .select("norm", "task", "descriptor", "stage", "matched_key")


@query("range_lookup_join")
def q_range_lookup_join(spark, sf):
    d = claim_rows(spark, sf)
    return _claims_out(d, "task", "descriptor", "lo", "hi")


@query("in_range_label")
def q_in_range_label(spark, sf):
    d = claim_rows(spark, sf).filter(F.col("claim_status") == "scored")
    return _claims_out(d, "value", "lo", "hi", F.col("range_label").cast("bigint").alias("range_label"))


@query("descriptor_join")
def q_descriptor_join(spark, sf):
    """J4 as an explicit equi-join on (smiles, descriptor) against the long
    descriptor table (the scorer itself reads the same values from an array)."""
    _, _, _, d = scoring_inputs(spark, sf)
    rows = claim_rows(spark, sf)
    rows = rows.filter(F.col("descriptor").isNotNull() & F.col("valid")).drop("value")
    long = R.descriptors_long(d)
    return _claims_out(rows.join(long, ["smiles", "descriptor"], "inner"), "smiles", "descriptor", "value")


@query("fuzzy_top1_join")
def q_fuzzy_top1_join(spark, sf):
    from chemscore.operators.resolve import fuzzy_top1, spread_words
    names = R.claim_names(view(spark, sf, "completions"), R.ScoreOptions())
    words = spread_words(names.select(X.normalize_name("prop").alias("norm")).distinct(), "norm")
    m = fuzzy_top1(words, "norm", dims.alias_keys(), 0.1, "m")
    return m.select("norm", F.col("m.key").alias("key"), r6(F.col("m.ratio")).alias("ratio"))


@query("match_trace")
def q_match_trace(spark, sf):
    from chemscore.operators.resolve import match_trace
    names = R.claim_names(view(spark, sf, "completions"), R.ScoreOptions())
    return match_trace(names, "prop").select("name", "norm", "task", "descriptor", "stage", "matched_key",
                                             r6(F.col("ratio")).alias("ratio"))


# ----- rewards ---------------------------------------------------------------------------

@query("advantage_detail")
def q_advantage_detail(spark, sf):
    d = claim_rows(spark, sf).filter(F.col("claim_status") == "scored")
    return _claims_out(d, "prop", F.col("label").cast("bigint").alias("label"), "descriptor", "value",
                       "lo", "hi", F.col("range_label").cast("bigint").alias("range_label"),
                       r6(F.col("agreement")).alias("agreement"))


@query("skip_unscorable")
def q_skip_unscorable(spark, sf):
    d = claim_rows(spark, sf)
    return _claims_out(d, "claim_status")


@query("reward_advantage")
def q_reward_advantage(spark, sf):
    s = scored(spark, sf, group=False)
    return s.select("prompt_id", "gen_idx", r6(F.col("reward_advantage")).alias("reward_advantage"))


@query("score_guards")
def q_score_guards(spark, sf):
    s = scored(spark, sf, group=False)
    return s.select("prompt_id", "gen_idx", "skip_reason", r6(F.col("reward_advantage")).alias("reward_advantage"))


@query("reward_total")
def q_reward_total(spark, sf):
    s = scored(spark, sf, group=False)
    return s.select("prompt_id", "gen_idx", "task", "reward_format", "reward_correctness", "reward_choices",
                    r6(F.col("reward_advantage")).alias("reward_advantage"),
                    r6(F.col("reward_total")).alias("reward_total"))


@query("group_advantage")
def q_group_advantage(spark, sf):
    s = scored(spark, sf, group=True)
    return s.select("prompt_id", "gen_idx", r6(F.col("reward_total")).alias("reward_total"),
                    r6(F.col("group_mean")).alias("group_mean"), r6(F.col("group_std")).alias("group_std"),
                    r6(F.col("advantage")).alias("advantage"))


@query("batch_task")
def q_batch_task(spark, sf):
    p = view(spark, sf, "prompts").withColumn("batch_id", F.floor(F.col("prompt_id") / 4).cast("bigint")) \
        .withColumn("pos", F.col("prompt_id"))
    return R.batch_task(p).select("prompt_id", "batch_id", "task", "batch_task")


@query("reward_summary")
def q_reward_summary(spark, sf):
    s = scored(spark, sf, group=False)
    out = R.reward_summary(s)
    return out.select("reward", "task", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                      r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"))


# ----- evaluation (E2-E7, E9, E10, P3, P4, P7, U1, W3) --------------------------------

def eval_input(spark, sf) -> DataFrame:
    """Deterministic scores for evaluation: ``documents.n_chars`` as the score,
    ``labels.quality`` as the label, joined on doc_id."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"),
                                               "lang", "source")
    return lab.join(doc, "doc_id", "inner")


def labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))


@query("roc_auc")
def q_roc_auc(spark, sf):
    from chemscore.operators import metrics as M
    return M.roc_auc(eval_input(spark, sf)).select(r6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@query("roc_curve")
def q_roc_curve(spark, sf):
    from chemscore.operators import metrics as M
    return M.roc_curve(eval_input(spark, sf)).select("threshold", "tp", "fp", r6(F.col("tpr")).alias("tpr"),
                                                     r6(F.col("fpr")).alias("fpr"))


@query("roc_curve_reduced")
def q_roc_curve_reduced(spark, sf):
    """E4 without the points on straight lines, the reference's default."""
    from chemscore.operators import metrics as M
    # coarse scores in long runs, so that there are straight lines to drop
    ev = eval_input(spark, sf).withColumn("score", F.floor(F.col("score") / 50).cast("double") * 50)
    return M.roc_curve(ev, drop_intermediate=True).select("threshold", "tp", "fp", r6(F.col("tpr")).alias("tpr"),
                                                          r6(F.col("fpr")).alias("fpr"))


@query("youden_threshold")
def q_youden_threshold(spark, sf):
    from chemscore.operators import metrics as M
    return M.youden_threshold(eval_input(spark, sf)).select("threshold", F.col("gain").cast("long").alias("gain"))


@query("apply_threshold")
def q_apply_threshold(spark, sf):
    from chemscore.operators import metrics as M
    ev = eval_input(spark, sf)
    t = M.scalar_threshold(ev)
    return M.apply_threshold(ev, t).select("doc_id", "score", F.col("label").cast("long").alias("label"),
                                           F.col("pred").cast("long").alias("pred"))


@query("accuracy")
def q_accuracy(spark, sf):
    from chemscore.operators import metrics as M
    ev = eval_input(spark, sf)
    t = M.scalar_threshold(ev)
    return M.accuracy(M.apply_threshold(ev, t)).select(F.lit(t).alias("threshold"),
                                                       r6(F.col("accuracy")).alias("accuracy"), "n")


@query("confusion_counts")
def q_confusion_counts(spark, sf):
    from chemscore.operators import metrics as M
    ev = eval_input(spark, sf)
    t = M.scalar_threshold(ev)
    out = M.confusion_counts(M.apply_threshold(ev, t))
    return out.select("label", "tp", "fp", "fn", "support", r6(F.col("precision")).alias("precision"),
                      r6(F.col("recall")).alias("recall"), r6(F.col("f1")).alias("f1"))


@query("roc_auc_by_group")
def q_roc_auc_by_group(spark, sf):
    from chemscore.operators import metrics as M
    return M.roc_auc(eval_input(spark, sf), by=["lang"]).select("lang", r6(F.col("auc")).alias("auc"),
                                                                  "n_pos", "n_neg")


@query("cv_best")
def q_cv_best(spark, sf):
    """(source, lang) stand in for (parameter setting, fold): AUC per cell, mean
    per setting, best setting."""
    from chemscore.operators import metrics as M
    cells = M.roc_auc(eval_input(spark, sf), by=["source", "lang"]).withColumnRenamed("source", "param")
    best = M.cv_best(cells, "param", "auc")
    return best.select("param", r6(F.col("mean_score")).alias("mean_score"), "n_settings")


@query("stratified_folds")
def q_stratified_folds(spark, sf):
    from chemscore.operators import folds as FO
    return FO.stratified_folds(labelled(spark, sf), "label", "doc_id", 5).select("doc_id", "label", "fold")


@query("concat_train_valid")
def q_concat_train_valid(spark, sf):
    from chemscore.operators import folds as FO
    f = FO.stratified_folds(labelled(spark, sf), "label", "doc_id", 5)
    return FO.concat_splits(train=f.filter(F.col("fold") >= 2), valid=f.filter(F.col("fold") == 1)) \
        .select("doc_id", "label", "split")


@query("balanced_weights")
def q_balanced_weights(spark, sf):
    from chemscore.operators import folds as FO
    return FO.balanced_weights(labelled(spark, sf)).select("doc_id", "label", r6(F.col("weight")).alias("weight"))


@query("cast_label")
def q_cast_label(spark, sf):
    from chemscore.operators import folds as FO
    lab = table(spark, sf, "labels")
    q1 = F.col("quality") == 1
    txt = (F.when(F.col("doc_id") % 3 == 0, F.when(q1, F.lit("True")).otherwise(F.lit("False")))
           .when(F.col("doc_id") % 3 == 1, F.when(q1, F.lit("1.0")).otherwise(F.lit("0.0")))
           .otherwise(F.when(q1, F.lit("1")).otherwise(F.lit("0"))))
    t = lab.select("doc_id", txt.alias("label_text"))
    return t.select("doc_id", "label_text", FO.cast_label("label_text").cast("long").alias("label"))


def doc_features(spark, sf) -> DataFrame:
    """P3 input: numeric features of every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split(F.col("text"), " ", -1)).cast("double").alias("n_words"),
                    F.size(F.split(F.col("text"), "\n", -1)).cast("double").alias("n_lines"))


@query("select_features")
def q_select_features(spark, sf):
    return doc_features(spark, sf).select("doc_id", "n_chars", "n_words", "n_lines")


# ----- learning (M1, M3, M5, M6, E8) --------------------------------------------------------

FEATURES = ["n_chars", "n_words", "n_lines"]


def learning_input(spark, sf) -> DataFrame:
    """Document features + quality label; splits from stratified folds of the
    labels (fold 0 test, fold 1 valid, the rest train)."""
    from chemscore.operators import folds as FO
    f = FO.stratified_folds(labelled(spark, sf), "label", "doc_id", 5, out="f5")
    from chemscore.session import materialize
    split = F.when(F.col("f5") == 0, F.lit("test")).when(F.col("f5") == 1, F.lit("valid")).otherwise(F.lit("train"))
    data = f.select("doc_id", F.col("label").cast("double").alias("label"), split.alias("split")) \
        .join(doc_features(spark, sf), "doc_id", "inner")
    # written once: every fit of the grid search reads the table, not the lineage
    return materialize(data, "learning-input")


# The exact learners draw from md5, so their trees, probabilities and importances have SQL oracles.  Values
# of the grid search depend on Spark ML's draws: its queries return what must hold for any right search.

def _fit(spark, sf):
    """(data, Spark ML forest of a grid setting fitted on train and validation rows)."""
    from pyspark.ml import Pipeline

    from chemscore.operators import ml
    data = learning_input(spark, sf)
    rf = ml.forest(setting=ml.GRID_SETTING)
    return data, Pipeline(stages=[ml.assembler(FEATURES), rf]).fit(data.filter(F.col("split") != "test"))


def folded(spark, sf) -> DataFrame:
    """Train and validation rows with their folds, staged: no fit recomputes them."""
    from chemscore.operators import folds as FO
    from chemscore.session import materialize
    data = learning_input(spark, sf).filter(F.col("split") != "test")
    return materialize(FO.stratified_folds(data, "label", "doc_id", 5, out="fold"), "learning-folds")


@query("rf_fit_score")
def q_rf_fit_score(spark, sf):
    """M1: the exact forest of a grid setting, fitted on train and validation rows, scores every row."""
    from chemscore.operators import ml, trees
    from chemscore.session import materialize
    data = learning_input(spark, sf)
    nodes = materialize(ml.exact_forest(data.filter(F.col("split") != "test"), FEATURES, "doc_id"), "forest-nodes")
    out = trees.score(data, nodes, FEATURES, ["doc_id", "split", "label"])
    return out.select("doc_id", "split", F.col("label").cast("long").alias("label"), r6(F.col("prob")).alias("prob"))


@query("grid_search_cv")
def q_grid_search_cv(spark, sf):
    """All settings of the reference grid, five folds each."""
    from chemscore.operators import ml
    tv = folded(spark, sf)
    size = tv.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("label").cast("long")).alias("n_pos"),
                  F.count_distinct("fold").alias("n_folds")).first()
    res = ml.grid_search_cv(tv, FEATURES, ml.REFERENCE_GRIDS["bbbp"], "fold")
    best = res.table.agg(F.max("mean_auc")).first()[0]
    chosen = F.lit(True)
    for k, v in res.best_params.items():
        chosen = chosen & (F.col(k) == v)
    return res.table.select("param_id", "numTrees", "maxDepth", "minInstancesPerNode",
                            *[F.lit(size[c]).cast("long").alias(c) for c in ("n_folds", "n_rows", "n_pos")],
                            F.col("mean_auc").between(0.0, 1.0).alias("auc_in_range"),
                            (~chosen | (F.col("mean_auc") == best)).alias("winner_is_best"))


@query("importance_rank")
def q_importance_rank(spark, sf):
    """Importances of the exact forest, recomputed from its nodes' gains."""
    from chemscore.operators import ml
    from chemscore.session import materialize
    data = learning_input(spark, sf).filter(F.col("split") != "test")
    nodes = materialize(ml.exact_forest(data, FEATURES, "doc_id"), "forest-nodes")
    return ml.feature_importances(nodes, FEATURES).select("feature", r6(F.col("importance")).alias("importance"), "rank")


@query("balanced_tree")
def q_balanced_tree(spark, sf):
    """M5: the whole node table of the depth-4 tree, with the rows of each node per class."""
    from chemscore.operators import ml
    nodes = ml.balanced_tree(learning_input(spark, sf).filter(F.col("split") != "test"), FEATURES)
    names = F.array(*[F.lit(f) for f in FEATURES])
    return nodes.select("node", F.col("depth").cast("int").alias("depth"), "c0", "c1", F.get(names, "feature").alias("feature"),
                        r6(F.col("threshold")).alias("threshold"), r6(F.col("gain")).alias("gain"), r6(F.col("prob")).alias("prob"))


@query("tune_and_apply")
def q_tune_and_apply(spark, sf):
    """The whole flow over the reference grid; every metric is recomputed here
    from the staged scores without the library's metric operators."""
    from chemscore.operators import ml
    from chemscore.operators.ordering import running_totals
    flow = ml.tune_and_apply(learning_input(spark, sf), FEATURES, ml.REFERENCE_GRIDS["bbbp"])
    got = {(r.split, r.metric): r.value for r in flow.metrics.collect()}
    t = got[("valid", "threshold")]
    s = flow.scored.withColumn("y", F.col("label").cast("long"))
    again = {(r.split, m): r[m] for r in s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.when(F.col("split") == "test", F.col("prob") >= t).otherwise(F.col("prediction") == 1.0).cast("long")
               == F.col("y")).cast("double")).alias("accuracy")).collect() for m in ("n", "accuracy")}
    rank = s.groupBy("split", "prob").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    less = F.col("cum_q") - F.col("q")
    auc = {r.split: r.auc for r in running_totals(rank, ["split"], "prob", ["q"]).groupBy("split").agg(
        (F.sum(F.col("p") * (less + F.col("q") / 2)) / F.sum("p") / F.sum("q")).alias("auc")).collect()}
    same = lambda a, b: a is not None and b is not None and abs(a - b) < 1e-9
    rows = [(x, m, again[(x, "n")], same(got[(x, m)], again[(x, m)] if m == "accuracy" else auc[x]))
            for x in ("valid", "test") for m in ("accuracy", "auc")]
    curve = flow.roc.agg(F.count(F.lit(1)).alias("n"), F.max("tp").alias("tp"), F.max("fp").alias("fp")).first()
    rows.append(("test", "roc_ends_at_all_rows", again[("test", "n")], curve.tp + curve.fp == again[("test", "n")]))
    rows.append(("cv", "best_auc_in_range", again[("valid", "n")], 0.0 <= got[("cv", "best_auc")] <= 1.0))
    return spark.createDataFrame(rows, "split string, metric string, n long, holds boolean")


# ----- streaming batch twin (ST2) ------------------------------------------------------------

@query("reward_metrics_windowed")
def q_reward_metrics_windowed(spark, sf):
    from chemscore.streaming.scoring import windowed_metrics
    ev = table(spark, sf, "events").select("ts", F.col("value").alias("value"), F.col("event_type").alias("task"))
    out = windowed_metrics(ev, "ts", "value", "task", "1 hour")
    return out.select("window_start", "window_end", "task", "n", r6(F.col("mean")).alias("mean"),
                      r6(F.col("std")).alias("std"), r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"))


@query("smote_oversample")
def q_smote_oversample(spark, sf):
    from chemscore.operators.smote import smote
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    data = lab.join(doc_features(spark, sf), "doc_id", "inner")
    out = smote(data, FEATURES, "label", "doc_id", k=5, seed=196)
    return out.select("i", "base_id", "nn_id", r6(F.col("gap")).alias("gap"),
                      *[r6(F.col(f)).alias(f) for f in FEATURES], "label")


# ----- sources, sinks, streams and the reward surface as registered queries -------------------
# Each reads the given tables; file-based steps first stage Spark-derived data
# under the checkpoint folder (a shared folder on a cluster).

def _staging(spark, label: str) -> str:
    import uuid

    from chemscore.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/chemscore-{label}-{uuid.uuid4().hex}"


@query("csv_scan")
def q_csv_scan(spark, sf):
    """Labelled document features written as a header CSV (label as text),
    read back with an explicit schema and the P4 label cast."""
    from chemscore.sources import files
    path = _staging(spark, "csv")
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("True"))
                                            .otherwise(F.lit("False")).alias("p_np"))
    lab.join(doc_features(spark, sf), "doc_id").select("doc_id", "n_chars", "n_words", "n_lines", "p_np") \
        .write.option("header", "true").csv(path)
    df = files.read_csv(spark, path, "doc_id BIGINT, n_chars DOUBLE, n_words DOUBLE, n_lines DOUBLE, p_np STRING")
    return df.select("doc_id", "n_chars", "n_words", "n_lines", F.col("label").cast("long").alias("label"))


@query("metrics_sink")
def q_metrics_sink(spark, sf):
    """The ROC points written as a parquet metric table and read back."""
    from chemscore.operators import metrics as M
    from chemscore.sources import files
    path = _staging(spark, "roc-points")
    files.write_metrics(M.roc_curve(eval_input(spark, sf)), path)
    out = spark.read.parquet(path)
    return out.select("threshold", "tp", "fp", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


@query("metrics_sink_runs")
def q_metrics_sink_runs(spark, sf):
    """S4 with a run key: two runs, then the first one's class counts again; the
    retry replaces its own partitions only."""
    from chemscore.sources import files
    path = _staging(spark, "metric-runs")
    per = eval_input(spark, sf).groupBy(F.col("label").cast("string").alias("split")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), r6(F.avg("score")).alias("mean_score"))
    rows = per.unpivot("split", ["rows", "mean_score"], "metric", "value")
    files.commit_metrics(rows.withColumn("value", F.col("value") + 1), path, "a")
    files.commit_metrics(rows, path, "b")
    files.commit_metrics(rows.where("metric = 'rows'"), path, "a")
    return files.read_metrics(spark, path, "value DOUBLE, run STRING, split STRING, metric STRING") \
        .select("run", "split", "metric", r6(F.col("value")).alias("value"))


@query("json_array_split")
def q_json_array_split(spark, sf):
    """S1 over files that hold one JSON array each, cut by Spark's byte ranges."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    parts = max(1, d.count() // 2_000)                                       # records of a file
    record = F.to_json(F.struct(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("instruction"),
                                F.coalesce("text", F.lit("")).alias("input"), (F.col("quality") == 1).alias("output")))
    path = _staging(spark, "json-arrays")
    (d.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
     .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
     .write.partitionBy("part").text(path))
    out = S.to_samples(S.read_json_array_split(spark, path).select("instruction", "input", "output"))
    return out.select(F.get(F.col("prompt"), F.lit(0))["content"].alias("instruction"),
                      F.md5(F.get(F.col("prompt"), F.lit(1))["content"]).alias("input_md5"), "answer")


@query("model_save_load")
def q_model_save_load(spark, sf):
    """S3: a fitted forest saved as a PipelineModel directory, loaded, and used to score."""
    from chemscore.operators import ml
    from chemscore.sources import files
    data, model = _fit(spark, sf)
    path = _staging(spark, "model")
    files.save_model(model, path)
    before = ml.positive_probability(model.transform(data)).select("doc_id", "split", F.col("prob").alias("p0"))
    after = ml.positive_probability(files.load_model(path).transform(data)).select("doc_id", "prob")
    return before.join(after, "doc_id").select("doc_id", "split", (F.col("p0") == F.col("prob")).alias("same_after_load"))


@query("reward_registry")
def q_reward_registry(spark, sf):
    """all four rewards and a Python one composed through the reward surface,
    over the scored completions (texts are scored before anything is joined)."""
    from chemscore.functions.registry import apply_rewards, builtin_rewards, python_reward
    rewards = builtin_rewards()
    rewards["answered"] = python_reward("n_claims", lambda n: float(n > 0))
    out = apply_rewards(scored(spark, sf, group=False).drop("reward_total"), rewards, {"answered": 0.0})
    return out.select("prompt_id", "gen_idx", "reward_format", "reward_correctness", "reward_choices",
                      r6(F.col("reward_advantage")).alias("reward_advantage"), "reward_answered",
                      r6(F.col("reward_total")).alias("reward_total"))


@query("stream_score")
def q_stream_score(spark, sf):
    """ST1: completions (derived from lineitem) arrive as files; the stream is
    run to completion (availableNow) and its sink table returned."""
    from chemscore.streaming import scoring as ST
    c, p, m, d = scoring_inputs(spark, sf)
    src = _staging(spark, "stream-in")
    c.write.parquet(src)
    sink, ck = _staging(spark, "stream-out"), _staging(spark, "stream-ckpt")
    ST.stream_score(spark, src, p, m, d, sink, ck).awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("prompt_id", "gen_idx", "reward_format", "reward_correctness", "reward_choices",
                      r6(F.col("reward_advantage")).alias("reward_advantage"),
                      r6(F.col("reward_total")).alias("reward_total"), "skip_reason")


@query("stream_group_advantage")
def q_stream_group_advantage(spark, sf):
    """R7 in a stream: events as generations, eight to a prompt, dealt over files
    so that most groups are split over micro-batches."""
    from chemscore.streaming import scoring as ST
    ev = table(spark, sf, "events").select(F.floor(F.col("event_id") / 8).cast("long").alias("prompt_id"),
                                           (F.col("event_id") % 8).alias("gen_idx"), F.col("value").alias("reward_total"),
                                           F.col("ts").cast("timestamp").alias("ts"))
    sizes = ev.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("group_size"))
    src = _staging(spark, "generations-in")
    ev.join(sizes, "prompt_id").select("prompt_id", "gen_idx", "reward_total", "group_size", "ts") \
        .repartition(6, F.xxhash64("prompt_id", "gen_idx")).write.parquet(src)
    sink, ck = _staging(spark, "advantages-out"), _staging(spark, "advantages-ckpt")
    ST.stream_group_advantage(spark, src, sink, ck, delay="36500 days", max_files_per_trigger=2).awaitTermination()
    out = spark.read.schema(ST.GROUPED).parquet(sink)
    return out.select("prompt_id", "gen_idx", r6(F.col("reward_total")).alias("reward_total"), r6(F.col("group_mean")).alias("group_mean"),
                      "group_size", r6(F.col("advantage")).alias("advantage"), "whole")


@query("stream_reward_metrics")
def q_stream_reward_metrics(spark, sf):
    """ST2: events arrive as files; each micro-batch leaves mergeable parts of its
    one-hour windows, and the merged table holds every window."""
    from chemscore.streaming import scoring as ST
    src = _staging(spark, "events-in")
    table(spark, sf, "events").select("ts", "value", F.col("event_type").alias("task")) \
        .repartition(4).write.parquet(src)
    sink, ck = _staging(spark, "metrics-out"), _staging(spark, "metrics-ckpt")
    ST.stream_metric_parts(spark, src, "ts TIMESTAMP_NTZ, value DOUBLE, task STRING", sink, ck,
                           max_files_per_trigger=2).awaitTermination()
    out = ST.merged_metrics(spark.read.parquet(sink))
    return out.select("window_start", "window_end", "task", "n", r6(F.col("mean")).alias("mean"),
                      r6(F.col("std")).alias("std"), r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"))
