"""Operators with state per key or bucket of keys, kept by Spark's state store: message admission and the spans of rounds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from veilframe.functions.sealing import NO_COUNTER, counter_or_default
from veilframe.operators.messages import STATUSES, open_messages, with_keys
from veilframe.sources.events import write_event_stream

#: State keys are never NULL: Spark mixes up the state of the keys that share a partition with a NULL one.
NO_KEY = ""


def state_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(column).cast("string")), F.lit(NO_KEY)).alias("_key")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: Clients share the state of a bucket, as a call for each costs far more than its few rows. A checkpoint depends on this number.
CLIENT_BUCKETS = 512


class Admission(StatefulProcessor):
    """Keeps the last accepted counters of a bucket of clients; see ``admitted``."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "clients array<string>, counters array<bigint>, at array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.counters.get() if self.counters.exists() else ([], [], [])
        known = {c: (n, at) for c, n, at in zip(*held, strict=True) if not self.ttl_ms or at + self.ttl_ms > now}
        batch = pd.concat(list(rows), ignore_index=True)
        codes, clients = pd.factorize(batch["client"])
        batch = batch.assign(code=codes).sort_values(["code", "seq"])
        code, counter = batch["code"].to_numpy(), batch["sent"].to_numpy(np.int64)
        registered, has_key, opened, authentic = (batch[c].to_numpy(bool) for c in ("registered", "has_key", "opened", "authentic"))
        before = np.array([known[c][0] if c in known else NO_COUNTER for c in clients], np.int64)
        start = before[code]
        moves = np.where(registered & has_key & opened, np.maximum(counter, start), start)
        reached = pd.Series(moves).groupby(code).cummax().to_numpy()
        first = np.concatenate([[True], code[1:] != code[:-1]])
        last = np.where(first, start, np.concatenate([[NO_COUNTER], reached[:-1]]))
        after = reached[np.concatenate([first[1:], [True]])]  # of every client, in the order of codes
        raised = np.flatnonzero(after > before)
        if len(raised):
            known.update((clients[i], (int(after[i]), now)) for i in raised)
            self.counters.update((list(known), [n for n, _ in known.values()], [at for _, at in known.values()]))
        checks = [~registered, counter <= last, ~has_key, ~opened, ~authentic]
        status = np.select(checks, list(STATUSES[:-1]), STATUSES[-1])
        payload = batch["payload"].where(status == STATUSES[-1], None)
        yield pd.DataFrame(
            {"seq": batch["seq"].to_numpy(), "client_id": batch["client_id"].to_numpy(), "sent": counter, "counted": batch["counted"].to_numpy(), "last_counter": last, "status": status, "payload": payload.to_numpy()}
        )

    def close(self) -> None:
        pass


def admitted(messages: DataFrame, registry: DataFrame, keys: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``admit`` on a stream: ``(seq, client_id, counter, last_counter, status, payload)``.

    Keys, decryption and tags are looked at before; what goes to the state is one row a message. A state value holds the counters of the
    clients of one of ``CLIENT_BUCKETS`` buckets. Messages of a micro-batch are taken in the order of ``seq``, micro-batches as they come, so
    size the trigger for what the clients of a bucket may send at a time. ``ttl_ms`` forgets clients that were silent for so long; their old
    messages can then be sent again, so only with keys that do not outlive it.
    """
    opened = open_messages(with_keys(messages, registry, keys))
    rows = opened.select(
        F.pmod(F.xxhash64("client_id"), F.lit(CLIENT_BUCKETS)).alias("bucket"), state_key("client_id").alias("client"), "seq", "client_id", counter_or_default().alias("sent"), F.col("counter").isNotNull().alias("counted"), F.col("_registered").alias("registered"),
        F.col("_key").isNotNull().alias("has_key"), F.coalesce("opened", F.lit(False)).alias("opened"), "authentic",
        F.when(F.col("authentic"), F.col("payload")).alias("payload"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    schema = f"seq {kinds['seq']}, client_id {kinds['client_id']}, sent bigint, counted boolean, last_counter bigint, status string, payload string"
    judged = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Admission(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    counter = F.when(F.col("counted"), F.col("sent")).cast(kinds["counter"]).alias("counter")
    return judged.select("seq", "client_id", counter, "last_counter", "status", "payload")


def start_admission(
    messages: DataFrame, registry: DataFrame, keys: DataFrame, path: str, checkpoint: str, every: str | None = None, ttl_ms: int | None = None
) -> StreamingQuery:
    """Admit a message stream into the folder ``path``; counters live in the checkpoint's RocksDB state."""
    with rocksdb(messages.sparkSession):
        return write_event_stream(admitted(messages, registry, keys, ttl_ms), path, checkpoint, every)


NEVER = -(1 << 62)  # stored for a time that is not known yet; state rows hold no NULLs


class Spans(StatefulProcessor):
    """First start and last end of a round; see ``round_spans``."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "started bigint, ended bigint, due bigint, version bigint")

    def _row(self, key, status: str, started: int, ended: int, due: int, version: int) -> pd.DataFrame:
        self.span.update((started, ended, due, version))
        known = [pd.array([None if x == NEVER else x], "Int64") for x in (started, ended)]
        return pd.DataFrame({"key": [key[0]], "started": known[0], "ended": known[1], "status": [status], "version": [version]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ended, due, version = self.span.get() if self.span.exists() else (NEVER, NEVER, NEVER, 0)
        if due != NEVER:
            self.handle.deleteTimer(due)
        for pdf in rows:
            starts, ends = pdf["started"].dropna(), pdf["ended"].dropna()
            if len(starts):
                started = min(int(starts.min()), started if started != NEVER else int(starts.min()))
            if len(ends):
                ended = max(int(ends.max()), ended)
            due = max(due, int(pdf["at"].max()) // 1000 + self.patience_ms)
        if ended == NEVER:
            self.handle.registerTimer(due)
        yield self._row(key, "running" if ended == NEVER else "completed", started, ended, due if ended == NEVER else NEVER, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, ended, due, version = self.span.get()
        yield self._row(key, "aborted", started, ended, NEVER, version + 1)

    def close(self) -> None:
        pass


def round_spans(events: DataFrame, lateness: str, patience_ms: int) -> DataFrame:
    """``rounds_from_events`` on a stream ``(ts, round, kind)``: a row whenever a round changes, the last ``version`` counts.

    A round is 'running' from its first event and 'completed' with its closing one. Where the watermark (``lateness`` behind the latest event)
    passes the round's last event by ``patience_ms`` without a closing one, an event-time timer makes it 'aborted'; a closing event that comes
    later still completes it.
    """
    micros = F.unix_micros("ts")
    rows = events.withWatermark("ts", lateness).select(
        "ts", state_key("round").alias("key"), micros.alias("at"), F.when(F.col("kind") == "round_start", micros).alias("started"), F.when(F.col("kind") == "round_complete", micros).alias("ended")
    )
    kind = events.schema["round"].dataType.simpleString()
    spans = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Spans(patience_ms),
        outputStructType="key string, started bigint, ended bigint, status string, version bigint",
        outputMode="Update",
        timeMode="EventTime",
    )
    seconds = (F.col("ended") - F.col("started")) / F.lit(1e6)
    round_no = F.nullif(F.substr("key", F.lit(2)), F.lit("")).cast(kind).alias("round")
    return spans.select(round_no, F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), seconds.alias("seconds"), "status", "version")
