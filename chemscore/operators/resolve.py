"""Property-name resolution.

Names are few and heavily skewed while claims are many, so the plan is:
claims -> normalized name -> ``distinct`` (partial aggregation collapses hot
names map-side) -> one UDF call per distinct name against each fixed key list
-> the three-stage cascade as Column logic and broadcast joins with the fixed
dictionaries -> a (norm, task) -> descriptor vocabulary that is joined back.
No name is ever shuffled once per claim and no cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.functions.similarity import closest_match_udf, closest_matches_udf
from chemscore.functions.text import normalize_name
from chemscore.plans import dims
from chemscore.session import materialize

DEFAULT_CUTOFF = 0.1


def registry_resolve(spark) -> DataFrame:
    """Registry key -> canonical descriptor name (function entries name
    themselves; name entries point at their target)."""
    return dims.registry_df(spark).select("key", F.col("descriptor").alias("canonical"), "is_function")


def spread_words(words: DataFrame, word_col: str, names_per_task: int = 2000,
                 staging_dir: str | None = None) -> DataFrame:
    """Distinct names, dealt over tasks for the similarity UDF.  It is CPU-heavy
    per row while the name table is tiny in bytes, so AQE would coalesce it
    into very few tasks: stage the names, count them and spread them over an
    explicit number of partitions (an explicit count is never coalesced)."""
    words = materialize(words, "distinct-names", staging_dir)
    return words.repartition(max(1, -(-words.count() // names_per_task)), word_col)


def fuzzy_top1(words: DataFrame, word_col: str, candidates, cutoff: float = DEFAULT_CUTOFF,
               out: str = "match") -> DataFrame:
    """Best candidate per word (ratio >= cutoff, best ratio, ties -> greatest key)."""
    udf = closest_match_udf(tuple(candidates), cutoff)
    return words.withColumn(out, udf(F.col(word_col)))


def _match(name: str):
    return F.struct(F.col(f"m.{name}_key").alias("key"), F.col(f"m.{name}_ratio").alias("ratio"))


def resolve_vocabulary(names: DataFrame, name_col: str = "prop",
                       cutoff: float = DEFAULT_CUTOFF, exact_first: bool = False,
                       names_per_task: int = 2000, staging_dir: str | None = None) -> DataFrame:
    """Resolve every distinct normalized name for every known task.

    Returns ``(norm, task, descriptor, stage, matched_key, ratio)`` with one
    row per distinct ``norm`` and task; ``descriptor`` is NULL when nothing
    matched (stage ``none``).  Tasks with identical range-key sets share one
    fallback UDF call.
    """
    spark = names.sparkSession
    words = names.select(normalize_name(F.col(name_col)).alias("norm")).distinct()
    words = spread_words(words, "norm", names_per_task, staging_dir)

    by_keyset: dict[tuple[str, ...], list[str]] = {}
    for t in dims.TASKS:
        by_keyset.setdefault(tuple(sorted(dims.range_keys(t))), []).append(t)
    sets = {"m_alias": dims.alias_keys(), "m_reg": dims.registry_keys()}
    per_task = []
    for i, (keys, tasks) in enumerate(by_keyset.items()):
        sets[f"m_fb{i}"] = keys
        per_task += [F.struct(F.lit(t).alias("task"), _match(f"m_fb{i}").alias("m_fb")) for t in tasks]
    # one Arrow pass per distinct word computes all three stages' best keys
    words = words.withColumn("m", closest_matches_udf(sets, cutoff)(F.col("norm")))
    words = words.select("norm", _match("m_alias").alias("m_alias"), _match("m_reg").alias("m_reg"),
                         F.explode(F.array(*per_task)).alias("tm"))
    words = words.select("norm", "m_alias", "m_reg", "tm.task", "tm.m_fb")

    alias = F.broadcast(dims.alias_df(spark).select(F.col("alias").alias("a_key"),
                                                    F.col("descriptor").alias("a_target")))
    reg = F.broadcast(registry_resolve(spark).select(F.col("key").alias("r_key"),
                                                     F.col("canonical").alias("r_target")))
    rng = dims.ranges_df(spark).select("task", "descriptor")
    rng_a = F.broadcast(rng.select(F.col("task").alias("ra_task"), F.col("descriptor").alias("ra_desc")))
    rng_r = F.broadcast(rng.select(F.col("task").alias("rr_task"), F.col("descriptor").alias("rr_desc")))

    v = (words.join(alias, F.col("m_alias.key") == F.col("a_key"), "left")
         .join(reg, F.col("m_reg.key") == F.col("r_key"), "left")
         .join(rng_a, (F.col("task") == F.col("ra_task")) & (F.col("a_target") == F.col("ra_desc")), "left")
         .join(rng_r, (F.col("task") == F.col("rr_task")) & (F.col("r_target") == F.col("rr_desc")), "left"))

    alias_ok = F.col("ra_desc").isNotNull()
    reg_ok = F.col("rr_desc").isNotNull()
    fb_ok = F.col("m_fb.key").isNotNull()
    stage = (F.when(alias_ok, F.lit("alias")).when(reg_ok, F.lit("rdkit"))
             .when(fb_ok, F.lit("fallback")).otherwise(F.lit("none")))
    descriptor = (F.when(alias_ok, F.col("a_target")).when(reg_ok, F.col("r_target"))
                  .when(fb_ok, F.col("m_fb.key")))
    matched = (F.when(alias_ok, F.col("m_alias.key")).when(reg_ok, F.col("m_reg.key"))
               .when(fb_ok, F.col("m_fb.key")))
    ratio = (F.when(alias_ok, F.col("m_alias.ratio")).when(reg_ok, F.col("m_reg.ratio"))
             .when(fb_ok, F.col("m_fb.ratio")))
    out = v.select("norm", "task", descriptor.alias("descriptor"), stage.alias("stage"),
                   matched.alias("matched_key"), ratio.alias("ratio"))
    if exact_first:
        # Option (quirk Q10 off): a name that already equals a range key of the
        # task, ignoring case, resolves to itself before the alias stage.
        exact = F.broadcast(rng.select(F.col("task").alias("e_task"), F.col("descriptor").alias("e_desc"),
                                       F.lower(F.col("descriptor")).alias("e_norm")))
        out = (out.join(exact, (F.col("task") == F.col("e_task")) & (F.col("norm") == F.col("e_norm")), "left")
               .select("norm", "task",
                       F.coalesce("e_desc", "descriptor").alias("descriptor"),
                       F.when(F.col("e_desc").isNotNull(), F.lit("exact")).otherwise(F.col("stage")).alias("stage"),
                       F.coalesce("e_desc", "matched_key").alias("matched_key"),
                       F.when(F.col("e_desc").isNotNull(), F.lit(1.0)).otherwise(F.col("ratio")).alias("ratio")))
    return out


VOCABULARY = "norm STRING, task STRING, descriptor STRING, stage STRING, matched_key STRING, ratio DOUBLE, version BIGINT"


def lasting_vocabulary(names: DataFrame, folder: str, version: int, name_col: str = "prop", cutoff: float = DEFAULT_CUTOFF,
                       exact_first: bool = False, names_per_task: int = 2000, staging_dir: str | None = None) -> DataFrame:
    """J6 against a vocabulary that lasts: only names that no earlier version
    holds are resolved, and they are added as the partition ``version`` of the
    table in ``folder``.  Returns the rows of the asked names.

    Versions are the numbers of a stream's micro-batches.  A repeated version
    looks at earlier ones only and replaces its own partition, so a retried
    batch neither loses nor doubles a name.  Every setting that changes matches
    has a table of its own under the folder.
    """
    spark = names.sparkSession
    path = f"{folder.rstrip('/')}/cutoff={cutoff}-exact={int(exact_first)}"
    words = materialize(names.select(normalize_name(F.col(name_col)).alias("norm")).distinct(), "asked-names", staging_dir)

    def table() -> DataFrame:
        return spark.read.schema(VOCABULARY).parquet(path)

    # the folder exists with its first version
    spark.createDataFrame([], VOCABULARY).write.mode("append").partitionBy("version").parquet(path)
    known = table().where(F.col("version") < version).select("norm").distinct()
    new = words.join(known, "norm", "left_anti")
    (resolve_vocabulary(new, "norm", cutoff, exact_first, names_per_task, staging_dir)
     .select("norm", "task", "descriptor", "stage", "matched_key", "ratio", F.lit(version).cast("long").alias("version"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))
    return table().where(F.col("version") <= version).join(words, "norm", "left_semi").drop("version")


def match_trace(names: DataFrame, name_col: str = "prop", cutoff: float = DEFAULT_CUTOFF) -> DataFrame:
    """Printed name -> normalized -> matched -> stage, one row per distinct
    (name, task), as a table instead of debug prints."""
    distinct_names = names.select(F.col(name_col).alias("name")).distinct()
    vocab = resolve_vocabulary(distinct_names, "name", cutoff)
    keyed = distinct_names.select("name", normalize_name(F.col("name")).alias("norm"))
    return keyed.join(vocab, "norm", "inner")
