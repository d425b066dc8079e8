"""Keyed state, timers and result tables of streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.operators import status as st
from veilframe.plans import registry as rg
from veilframe.sources.events import read_event_stream
from veilframe.storage import commit_text, names_in, new_path, read_text
from veilframe.streaming import rounds as sr
from veilframe.streaming import upsert as up

PAIR = "k string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), PAIR)


def test_a_batch_replaces_only_buckets_with_changed_keys(spark):
    path, schema = new_path(spark, "table"), rows(spark).schema
    read = lambda b=None: as_set(up.read_upserts(spark, path, schema, b), "k", "v")
    assert read() == set()
    up.upsert(rows(spark, *[(f"k{i}", i) for i in range(50)], (None, -1)), 0, path, ["k"], buckets=8)
    first = up._folders(spark, path, 0)
    up.upsert(rows(spark, ("k3", 300), (None, -2)), 4, path, ["k"], buckets=8)
    second = up._folders(spark, path, 4)
    changed = {b for b in first if first[b] != second[b]}
    assert 1 <= len(changed) <= 2 and set(first) == set(second)
    want = {(f"k{i}", 300 if i == 3 else i) for i in range(50)} | {(None, -2)}
    assert read() == want and read(0) == read(3) == {(f"k{i}", i) for i in range(50)} | {(None, -1)}
    # the same batch again changes nothing, whatever it holds
    up.upsert(rows(spark, ("k3", 999)), 4, path, ["k"], buckets=8)
    assert read() == want and up._folders(spark, path, 4) == second


def test_a_batch_that_died_before_its_manifest_starts_over(spark, monkeypatch):
    path, schema = new_path(spark, "table"), rows(spark).schema
    up.upsert(rows(spark, ("a", 1), ("b", 1)), 0, path, ["k"], buckets=2)
    with monkeypatch.context() as m:
        m.setattr(up, "commit_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            up.upsert(rows(spark, ("a", 2), ("c", 2)), 1, path, ["k"], buckets=2)
    assert as_set(up.read_upserts(spark, path, schema), "k", "v") == {("a", 1), ("b", 1)}
    up.upsert(rows(spark, ("a", 2), ("c", 2)), 1, path, ["k"], buckets=2)
    assert as_set(up.read_upserts(spark, path, schema), "k", "v") == {("a", 2), ("b", 1), ("c", 2)}


def test_the_last_version_of_a_key_counts(spark):
    path = new_path(spark, "table")
    up.upsert(rows(spark, ("a", 1), ("a", 3), ("a", 2), (None, 5), (None, 4)), 0, path, ["k"], "v")
    assert as_set(up.read_upserts(spark, path, rows(spark).schema), "k", "v") == {("a", 3), (None, 5)}


def test_small_files_appear_whole_and_once(spark):
    path = new_path(spark, "notes") + "/one.json"
    assert commit_text(spark, path, "ä") and not commit_text(spark, path, "b")
    assert read_text(spark, path) == "ä" and names_in(spark, path.rsplit("/", 1)[0]) == ["one.json"]
    assert names_in(spark, new_path(spark, "nothing")) == []


def test_a_ledger_goes_on_where_it_stopped(spark):
    source, out, marks = (new_path(spark, n) for n in ("steps", "ledger", "marks"))
    schema = "client_id string, epoch int, seq bigint, epsilon double"
    for part in range(3):
        spark.createDataFrame([("a", 1, part, 0.5), ("b", part, part, 1.0)], schema).write.mode("append").parquet(source)
        got = sr.latest_result(sr.stream_ledger(read_event_stream(spark, source, schema)), spark, "ledger", ["client_id", "epoch"], path=out, checkpoint=marks)
    assert as_set(got, "client_id", "epoch", "spent", "steps") == {("a", 1, 1.5, 3), ("b", 0, 1.0, 1), ("b", 1, 1.0, 1), ("b", 2, 1.0, 1)}


def test_timers_abort_rounds_that_stay_open(spark):
    source, out, marks = (new_path(spark, n) for n in ("feed", "spans", "marks"))
    schema = "ts timestamp, round int, kind string"

    def after(*events):
        start = dt.datetime(2024, 1, 1)
        values = [(start + dt.timedelta(minutes=m), r, k) for m, r, k in events]
        spark.createDataFrame(values, schema).write.mode("append").parquet(source)
        spans = sr.stream_spans(read_event_stream(spark, source, schema), spark, "1 minute", 10 * 60_000, out, marks)
        return {r["round"]: (r.seconds, r.status) for r in spans.collect()}

    assert after((0, 1, "round_start"), (1, 2, "round_start"), (3, 1, "round_complete"), (2, None, "noise")) == {1: (180.0, "completed"), 2: (None, "running"), None: (None, "running")}
    got = after((30, 3, "round_start"))
    assert got[2] == (None, "aborted") and got[3] == (None, "running")
    assert after((31, 2, "round_complete"))[2] == (1800.0, "completed")
    batch = st.rounds_from_events(spark.read.parquet(source).where("round < 3").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert as_set(batch, "round", "seconds") == {(1, 180.0), (2, 1800.0)}


def test_streamed_updates_are_derived_once_and_read_by_all_cores(spark, monkeypatch):
    derived, triggers, updates, read = [], [], rg.updates, rg.ev.read_event_stream
    monkeypatch.setattr(rg, "updates", lambda *a: derived.append(a) or updates(*a))
    monkeypatch.setattr(rg.ev, "read_event_stream", lambda *a, **k: triggers.append(k["files_per_trigger"]) or read(*a, **k))
    got = rg.stream_median_sketch(spark, "/root/testdata/sf0.001").collect()
    assert len(derived) == 1 and triggers == [spark.sparkContext.defaultParallelism]
    counts = updates(spark, "/root/testdata/sf0.001").groupBy("round", "param", "idx").count()
    assert {(r.round, r.param, r.idx): r.n for r in got} == {(r.round, r.param, r.idx): r["count"] for r in counts.collect()}
    assert all(r.near for r in got)
