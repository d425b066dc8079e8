"""Continuous forms: combining updates, admitting messages, tracking budgets and client status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.combine import collect_updates, median_sketch, median_update, sketch_median
from veilframe.operators.privacy import budget_totals
from veilframe.operators.status import resolve_status, status_state
from veilframe.sources.events import run_batches
from veilframe.storage import new_path
from veilframe.streaming.keyed import rocksdb, round_spans, start_admission
from veilframe.streaming.upsert import read_upserts, start_upserts


def stream_combine(updates: DataFrame, width: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Weighted mean per element and round window.

    State is two sums per element. In append or update mode an update older than the watermark is dropped.
    """
    usable = collect_updates(updates)
    sums = usable.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("span"), "param", "idx").agg(
        F.try_divide(F.sum(F.col("num_samples") * F.col("value")), F.sum("num_samples")).alias("value")
    )
    return sums.select(F.col("span.start").alias("round_start"), "param", "idx", "value")


def latest_result(
    df: DataFrame, spark: SparkSession, name: str, keys: Sequence[str], order: str | None = None, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Result table of an update-mode stream after all available input; give ``path`` and ``checkpoint`` to go on with them later."""
    out, marks = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    start_upserts(df, out, marks, keys, order).awaitTermination()
    return read_upserts(spark, out, df.schema)


def stream_median_sketch(updates: DataFrame, spark: SparkSession, width: str, lateness: str, ts: str = "ts", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Approximate medians per element and round window: ``(round_start, param, idx, n, value)``.

    The state is one sketch per element of a window that is still open; the result table keeps the sketches, so that windows of several
    streams can be merged later.
    """
    windowed = updates.withWatermark(ts, lateness).withColumn("round_start", F.window(ts, width))
    sketches = median_sketch(windowed, ["round_start", "param", "idx"]).withColumn("round_start", F.col("round_start.start"))
    return sketch_median(latest_result(sketches, spark, "sketches", ["round_start", "param", "idx"], path=path, checkpoint=checkpoint))


def stream_median(updates: DataFrame, spark: SparkSession) -> DataFrame:
    """Coordinate medians of the rounds a stream delivered.

    A median has no small state, so the stream only files updates by round; closing is the batch median over the
    filed table. A batch that is delivered again replaces its own files.
    """
    out, checkpoint = new_path(spark, "updates"), new_path(spark, "updates-checkpoint")

    def file(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("round").parquet(f"{out}/batch={batch_id}")

    run_batches(collect_updates(updates), file, checkpoint)
    return median_update(spark.read.schema(updates.schema).parquet(out))


def stream_admit(messages: DataFrame, registry: DataFrame, keys: DataFrame, path: str, checkpoint: str) -> None:
    """Admit all available messages of a stream into the folder ``path``; the last counters stay in the checkpoint's state."""
    start_admission(messages, registry, keys, path, checkpoint).awaitTermination()


def stream_ledger(steps: DataFrame) -> DataFrame:
    """Running spend and steps per client and epoch."""
    return budget_totals(steps)


def stream_status(feed: DataFrame, spark: SparkSession) -> DataFrame:
    """Latest status per client."""
    return resolve_status(latest_result(status_state(feed), spark, "status", ["client_id"]))


def stream_spans(events: DataFrame, spark: SparkSession, lateness: str, patience_ms: int, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Spans of the rounds a stream delivered."""
    with rocksdb(spark):
        return latest_result(round_spans(events, lateness, patience_ms), spark, "spans", ["round"], "version", path, checkpoint).drop("version")
