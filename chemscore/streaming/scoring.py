"""Structured Streaming versions of the scoring job (ST1) and of the per-step
reward logging (ST2).

ST1: completions arrive as files; each micro-batch is scored with exactly the
batch operators (stream-static joins against prompts, molecules and
descriptors).  The name vocabulary needs the distinct names of the batch, so
the micro-batch is handed to ``foreachBatch``; the output of batch ``b`` is
written to its own ``batch_id=b`` partition with dynamic overwrite, so a
retried batch replaces its earlier attempt (exactly-once output).  Names are
resolved once in a stream's life: the vocabulary is a table beside the stream,
one partition a batch, and a batch resolves only names it does not hold.  The
group advantage needs whole prompt groups; it is computed per micro-batch when
the producer writes complete groups (``complete_groups=True``), as the trainer
does (all generations of a prompt in one step).  ``stream_group_advantage``
(R7) puts together groups whose generations arrive in different micro-batches:
keyed state holds its generations until the group is whole or the
watermark has passed its last one.

ST2: event-time metrics per reward and task in tumbling windows, in two forms.
``stream_reward_metrics`` emits finished windows once, in append mode behind a
watermark, for live views.  ``stream_metric_parts`` writes each micro-batch's
mergeable window parts, and ``merged_metrics`` puts them together: complete,
late rows and open windows included, and independent of how files fall into
micro-batches.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from chemscore._ship import ship_by_value
from chemscore.operators import rewards as R

ship_by_value(__name__)

COMPLETION_SCHEMA = "prompt_id BIGINT, gen_idx BIGINT, completion STRING"


def score_batch(batch: DataFrame, prompts: DataFrame, molecules: DataFrame, descriptors: DataFrame,
                opts: R.ScoreOptions, complete_groups: bool) -> DataFrame:
    return R.score_completions(batch, prompts, molecules, descriptors, opts, with_group_advantage=complete_groups)


def stream_score(spark: SparkSession, source_dir: str, prompts: DataFrame, molecules: DataFrame,
                 descriptors: DataFrame, sink_dir: str, checkpoint_dir: str,
                 opts: R.ScoreOptions | None = None, complete_groups: bool = False,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST1: score a stream of completion files into a parquet table.

    Per-batch staging tables live in one folder under the stream's checkpoint
    location and are overwritten by the next batch; the vocabulary there lasts."""
    opts = dataclasses.replace(opts or R.ScoreOptions(),
                               staging_dir=f"{checkpoint_dir.rstrip('/')}/_staging")
    reader = spark.readStream.schema(COMPLETION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mine = dataclasses.replace(opts, vocabulary_dir=f"{checkpoint_dir.rstrip('/')}/_vocabulary", vocabulary_version=batch_id)
        out = score_batch(batch, prompts, molecules, descriptors, mine, complete_groups)
        (out.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


GENERATIONS = "prompt_id BIGINT, gen_idx BIGINT, reward_total DOUBLE, group_size BIGINT, ts TIMESTAMP"
GROUPED = ("prompt_id BIGINT, gen_idx BIGINT, reward_total DOUBLE, group_mean DOUBLE, group_std DOUBLE, group_size BIGINT, "
           "advantage DOUBLE, whole BOOLEAN")
#: Prompts share keyed state by a hash, so that a call of the state function handles many groups at once.
GROUP_BUCKETS = 1024
_HELD = {"prompt_id": "int64", "none": "int64", "gen_idx": "int64", "reward_total": "float64", "size": "int64", "last": "int64", "due": "int64"}
_GROUP_STATE = ", ".join(f"{c} ARRAY<{'DOUBLE' if t == 'float64' else 'BIGINT'}>" for c, t in _HELD.items())


def _hold_groups(eps: float):
    """State of a bucket of prompts: the generations of their groups that are not whole, row by row, each with
    its group's size, last time and the watermark at which the group is due."""
    def hold(key, parts, state):
        mark = state.getCurrentWatermarkMs()
        held = pd.DataFrame({c: np.array(v, dtype=t) for (c, t), v in zip(_HELD.items(), state.get, strict=True)}) \
            if state.exists else pd.DataFrame({c: np.empty(0, t) for c, t in _HELD.items()})
        kept = len(held)
        if not state.hasTimedOut:
            new = pd.concat(list(parts)).rename(columns={"group_size": "size", "ms": "last"}).assign(due=0)
            held = pd.concat([held, new[list(_HELD)].astype(_HELD)], ignore_index=True)
        group = held.groupby(["prompt_id", "none"]).ngroup().to_numpy()
        n = int(group.max()) + 1 if len(held) else 0
        size, last, due = (np.full(n, -1 << 62) for _ in range(3))
        touched = np.zeros(n, bool)
        for into, column in ((size, "size"), (last, "last"), (due, "due")):
            np.maximum.at(into, group, held[column].to_numpy())
        touched[group[kept:]] = True
        # a generation that comes again changes nothing
        first = ~held.assign(g=group).duplicated(["g", "gen_idx"]).to_numpy()
        held, group = held[first], group[first]
        count = np.bincount(group, minlength=n)
        whole = count >= size
        due = np.where(touched, np.maximum(last, mark) + 1, due)
        leaves = whole | (~touched & (due <= mark))
        stays = held[~leaves[group]].assign(size=size[group][~leaves[group]], last=last[group][~leaves[group]],
                                            due=due[group][~leaves[group]])
        if len(stays):
            state.update(tuple(stays[c].tolist() for c in _HELD))
            state.setTimeoutTimestamp(int(max(stays["due"].min(), mark + 1)))
        elif state.exists:
            state.remove()
        out, g = held[leaves[group]], group[leaves[group]]
        if not len(out):
            return
        r = out["reward_total"].to_numpy()
        mean = (np.bincount(g, r, n) / np.maximum(count, 1))[g]
        square = np.bincount(g, (r - mean) ** 2, n)
        std = np.where(count > 1, np.sqrt(square / np.maximum(count - 1, 1)), np.nan)[g]
        yield pd.DataFrame({
            "prompt_id": pd.Series(out["prompt_id"].to_numpy(), dtype="Int64").mask(out["none"].to_numpy() == 1).array,
            "gen_idx": out["gen_idx"].to_numpy(), "reward_total": r, "group_mean": mean, "group_std": std,
            "group_size": count[g], "advantage": (r - mean) / (np.where(np.isnan(std), 0.0, std) + eps), "whole": whole[g]})
    return hold


def stream_group_advantage(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, eps: float = 1e-4,
                           delay: str = "1 hour", available_now: bool = True,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    """R7 over a stream of scored completions (prompt_id, gen_idx, reward_total,
    group_size: how many generations the prompt gets, ts: when it was scored),
    whose groups may be split over micro-batches and arrive in any order.

    A group leaves, exactly once, when it is whole; its state is dropped then.
    Prompts are dealt to ``GROUP_BUCKETS`` buckets by a hash, and a bucket's state
    holds its groups that are not whole yet.  Generations may be ``delay`` late; a group
    that is still incomplete once the watermark has passed its last generation
    leaves as it is (``whole`` false), for what it lacks could only come too
    late."""
    reader = spark.readStream.schema(GENERATIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = reader.parquet(source_dir).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("prompt_id"), F.lit(GROUP_BUCKETS)).alias("bucket"), F.coalesce("prompt_id", F.lit(0)).alias("prompt_id"),
        F.col("prompt_id").isNull().cast("long").alias("none"), "gen_idx", "reward_total", "group_size", F.unix_millis("ts").alias("ms"), "ts")
    out = rows.groupBy("bucket").applyInPandasWithState(
        _hold_groups(eps), GROUPED, _GROUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    writer = (out.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def windowed_metrics(df: DataFrame, ts: str = "ts", value: str = "value", task: str = "task",
                     window: str = "1 hour") -> DataFrame:
    """Batch twin of ST2 (``reward_metrics_windowed``): per tumbling window and task."""
    w = F.window(F.col(ts), window)
    agg = df.groupBy(w.alias("w"), F.col(task).alias("task")).agg(
        F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                      "task", "n", "mean", "std", "min", "max")


def stream_reward_metrics(spark: SparkSession, source_dir: str, schema: str, sink_dir: str,
                          checkpoint_dir: str, ts: str = "ts", value: str = "value", task: str = "task",
                          window: str = "1 hour", watermark: str = "1 hour",
                          available_now: bool = True) -> StreamingQuery:
    """ST2: watermark + tumbling-window aggregation in append mode to parquet."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as wall-clock in the session zone
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    out = windowed_metrics(stream, ts, value, task, window)
    writer = (out.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_metric_parts(spark: SparkSession, source_dir: str, schema: str, sink_dir: str,
                        checkpoint_dir: str, ts: str = "ts", value: str = "value", task: str = "task",
                        window: str = "1 hour", available_now: bool = True,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST2, complete form: per micro-batch one part (count, mean, sum of squared
    deviations, min, max) of each window and task that it touches.  A retried
    batch replaces its own parts; no state is kept between batches."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def handle(batch: DataFrame, batch_id: int) -> None:
        w = F.window(F.col(ts).cast("timestamp"), window)
        parts = batch.groupBy(w.alias("w"), F.col(task).alias("task")).agg(
            F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(F.col(value))).alias("m2"), F.min(value).alias("min"), F.max(value).alias("max"))
        (parts.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    writer = reader.parquet(source_dir).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def merged_metrics(parts: DataFrame) -> DataFrame:
    """The windows' metrics from their parts: a group has one part a micro-batch
    that touched it; means and squared deviations are merged pairwise."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a, b):
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2")))

    grouped = parts.groupBy("w", "task").agg(
        F.sort_array(F.collect_list(F.struct("batch_id", "n", "mean", "m2"))).alias("parts"),
        F.min("min").alias("min"), F.max("max").alias("max"))
    all_ = grouped.withColumn("t", F.aggregate("parts", zero, merge))
    n = F.col("t.n")
    return all_.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "task", n.alias("n"),
                       F.when(n > 0, F.col("t.mean")).alias("mean"),
                       F.when(n > 1, F.sqrt(F.col("t.m2") / (n - 1))).alias("std"), "min", "max")
