"""Stream = batch for ST1; ST2 emits the closed windows of the batch twin."""

import os

from pyspark.sql import functions as F

from chemscore.operators import rewards as R
from chemscore.plans.views import view
from chemscore.streaming import scoring as ST

from fixtures_core import SF001


def test_stream_score_equals_batch(spark, scratch):
    c, p, m, d = (view(spark, SF001, n) for n in ("completions", "prompts", "molecules", "descriptors_wide"))
    src = os.path.join(scratch, "in")
    # three arriving files, each holding complete prompt groups; one file per trigger
    for i in range(3):
        c.filter(F.col("prompt_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    q = ST.stream_score(spark, src, p, m, d, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"),
                        complete_groups=True, max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(scratch, "out"))
    assert out.select("batch_id").distinct().count() == 3
    want = R.score_completions(c, p, m, d, with_group_advantage=True)
    cols = ["prompt_id", "gen_idx", "reward_format", "reward_correctness", "reward_choices",
            "reward_advantage", "reward_total", "skip_reason"]
    got_rows = sorted(out.select(*cols, F.round("advantage", 9).alias("adv")).collect())
    want_rows = sorted(want.select(*cols, F.round("advantage", 9).alias("adv")).collect())
    assert got_rows == want_rows


def test_stream_reward_metrics(spark, scratch):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("ts", "value", F.col("event_type").alias("task"))
    src = os.path.join(scratch, "events")
    ev.write.parquet(src)
    q = ST.stream_reward_metrics(spark, src, "ts TIMESTAMP_NTZ, value DOUBLE, task STRING",
                                 os.path.join(scratch, "m"), os.path.join(scratch, "mck"))
    q.awaitTermination()
    batch = {(r.window_start, r.task): r.n for r in ST.windowed_metrics(ev).collect()}
    path = os.path.join(scratch, "m")
    stream = {(r.window_start, r.task): r.n for r in spark.read.parquet(path).collect()}
    assert stream, "closed windows must be emitted"
    for k, n in stream.items():
        assert batch[k] == n


def test_merged_parts_hold_every_window(spark, scratch):
    """Open windows and rows that arrive late are all there, however files fall into batches."""
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("ts", "value", F.col("event_type").alias("task"))
    ev = ev.withColumn("value", F.when(F.col("value") > 1, F.col("value")))      # some nulls
    src = os.path.join(scratch, "events")
    for part in (ev.where("pmod(hash(ts), 3) = 2"), ev.where("pmod(hash(ts), 3) = 0"), ev.where("pmod(hash(ts), 3) = 1")):
        part.coalesce(1).write.mode("append").parquet(src)
    sink = os.path.join(scratch, "parts")
    ST.stream_metric_parts(spark, src, "ts TIMESTAMP_NTZ, value DOUBLE, task STRING", sink, os.path.join(scratch, "ck"),
                           max_files_per_trigger=1).awaitTermination()
    parts = spark.read.parquet(sink)
    assert parts.select("batch_id").distinct().count() == 3
    r9 = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(r9, ST.merged_metrics(parts).collect()), key=str) == \
        sorted(map(r9, ST.windowed_metrics(ev).collect()), key=str)
