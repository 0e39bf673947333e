"""Groups put together over micro-batches, and a vocabulary that outlives them."""

import datetime
import os
import random

from pyspark.sql import functions as F

from chemscore.operators import resolve
from chemscore.operators import rewards as R
from chemscore.plans.views import view
from chemscore.streaming import scoring as ST

from fixtures_core import SF001

ROWS = "prompt_id long, gen_idx long, reward_total double, group_size long, ts timestamp"
NOON = datetime.datetime(2024, 5, 1, 12, 0, 0)


def test_split_groups_equal_the_batch_form(spark, scratch):
    rnd = random.Random(4)
    rows = [(p, g, round(rnd.gauss(0, 2), 3), n, NOON + datetime.timedelta(seconds=rnd.randrange(600))) for p in range(40) for n in (rnd.choice([1, 2, 8]),) for g in range(n)]
    want = {(r.prompt_id, r.gen_idx): r.advantage for r in
            R.group_advantage(spark.createDataFrame(rows, ROWS)).collect()}
    rnd.shuffle(rows)
    src = os.path.join(scratch, "in")
    for i in range(5):                                                  # every group in files of any order; some rows twice
        part = rows[i::5] + (rows[:20] if i == 3 else [])
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(src)
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    ST.stream_group_advantage(spark, src, out, ck, max_files_per_trigger=1).awaitTermination()
    got = spark.read.parquet(out).where("whole").collect()
    assert {(r.prompt_id, r.gen_idx) for r in got} == set(want)
    assert all(abs(r.advantage - want[r.prompt_id, r.gen_idx]) < 1e-9 for r in got)


def test_an_incomplete_group_leaves_when_the_watermark_has_passed(spark, scratch):
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    later = NOON + datetime.timedelta(hours=5)
    spark.createDataFrame([(1, 0, 1.0, 3, NOON), (1, 2, 3.0, 3, NOON), (3, 0, 9.0, 2, NOON + datetime.timedelta(hours=4, minutes=30))],
                          ROWS).coalesce(1).write.parquet(src)
    ST.stream_group_advantage(spark, src, out, ck).awaitTermination()
    spark.createDataFrame([(2, 0, 5.0, 1, later), (3, 1, 7.0, 2, later)], ROWS).coalesce(1).write.mode("append").parquet(src)
    ST.stream_group_advantage(spark, src, out, ck).awaitTermination()
    got = {(r.prompt_id, r.gen_idx): (r.group_mean, r.group_size, r.whole) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0): (2.0, 2, False), (1, 2): (2.0, 2, False), (2, 0): (5.0, 1, True), (3, 0): (8.0, 2, True), (3, 1): (8.0, 2, True)}


def test_a_name_is_resolved_once_and_retries_change_nothing(spark, scratch):
    folder = os.path.join(scratch, "vocabulary")
    batches = [["Mol Wt", "logp", "tpsa"], ["MOLWT", "LogP", "hbd"], ["hbd", "hba", "mol_wt"]]
    names = lambda b: spark.createDataFrame([(n,) for n in b], "prop string")
    for version, b in [(0, batches[0]), (1, batches[1]), (1, batches[1]), (2, batches[2]), (1, batches[1])]:
        got = resolve.lasting_vocabulary(names(b), folder, version)
        want = resolve.resolve_vocabulary(names(b))
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    held = spark.read.parquet(os.path.join(folder, "cutoff=0.1-exact=0")).groupBy("norm").agg(
        F.count_distinct("version").alias("n"), F.min("version").alias("first")).collect()
    assert {r.norm: (r.n, r.first) for r in held} == {"molwt": (1, 0), "logp": (1, 0), "tpsa": (1, 0), "hbd": (1, 1), "hba": (1, 2)}


def test_stream_resolves_names_over_its_whole_life(spark, scratch):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    src, ck = os.path.join(scratch, "in"), os.path.join(scratch, "ck")
    for i in range(2):
        c.filter(F.col("prompt_id") % 2 == i).coalesce(1).write.mode("append").parquet(src)
    ST.stream_score(spark, src, p, m, d, os.path.join(scratch, "out"), ck, max_files_per_trigger=1).awaitTermination()
    held = spark.read.parquet(os.path.join(ck, "_vocabulary", "cutoff=0.1-exact=0"))
    per = held.groupBy("norm", "task").count().agg(F.max("count")).first()[0]
    assert per == 1 and held.select("norm").distinct().count() >= 10
    want = R.score_completions(c, p, m, d, with_group_advantage=False)
    cols = ["prompt_id", "gen_idx", "reward_total", "skip_reason"]
    got = spark.read.parquet(os.path.join(scratch, "out"))
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_prompts_share_keyed_state(spark, scratch):
    """Many groups are held under few keys, so that one call of the state function handles many of them."""
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    half = lambda g: spark.range(6_000).select("id", F.lit(g).alias("gen_idx"), (F.col("id") + g).cast("double"),
                                               F.lit(2), F.lit(NOON)).toDF("prompt_id", "gen_idx", "reward_total", "group_size", "ts")
    for g in (0, 1):
        half(g).selectExpr("prompt_id", "cast(gen_idx as long) gen_idx", "reward_total", "cast(group_size as long) group_size", "ts") \
            .coalesce(1).write.mode("append").parquet(src)
        query = ST.stream_group_advantage(spark, src, out, ck)
        query.awaitTermination()
        keys = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
        assert keys <= ST.GROUP_BUCKETS
        assert spark.read.schema(ST.GROUPED).parquet(out).where("whole").count() == 12_000 * g
