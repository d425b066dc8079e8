"""Event feeds as streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

# Event types of the feed.
EVENT_TYPES = (
    "reset",
    "round_start",
    "client_status",
    "server_aggregating",
    "round_complete",
    "training_done",
    "threat_update",
)
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def utc(ts: str | Column) -> Column:
    """TIMESTAMP_NTZ as an instant, read as UTC whatever the session's zone; watermarks need instants."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts) if isinstance(ts, str) else ts))


def read_event_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str = EVENT_SCHEMA,
    glob: str = "*.parquet",
    props: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; ``props`` is a DDL schema that parses the JSON column of that name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events = reader.parquet(path)
    return events.withColumn("props", F.from_json("props", props)) if props else events


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def write_event_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the stream to a folder any number of readers can follow.

    Ends when the input is used up, or keeps running with a batch ``every`` interval ("10 seconds").
    """
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def start_batches(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Feed micro-batches to ``handle``; the running query. ``every`` as for ``write_event_stream``."""
    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Feed every available micro-batch to ``handle`` and wait for the end."""
    start_batches(df, handle, checkpoint, mode).awaitTermination()
