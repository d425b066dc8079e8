import hmac
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import as_set, key_table
from veilframe.functions import sealing as s
from veilframe.operators import messages as msg
from veilframe.sources.events import read_event_stream
from veilframe.storage import materialize, new_path
from veilframe.streaming import keyed
from veilframe.streaming.rounds import stream_admit


def test_tag_is_hmac(spark):
    keys = key_table(spark, ["a", "b"])
    inner, outer = s.hmac_pads(F.col("tag_key"))
    rows = keys.select("client_id", "tag_key", s.tag(F.lit("hällo"), inner, outer).alias("t")).collect()
    assert all(r.t == hmac.new(bytes(r.tag_key), "hällo".encode(), "sha256").hexdigest() for r in rows)


def test_seal_binds_the_associated_data(spark):
    df = spark.createDataFrame([("client_1", 1, bytes(range(32)))], "client_id string, counter bigint, k binary")
    sealed = materialize(df.withColumn("c", s.seal(F.lit("hello"), F.col("k"), s.aad())), "one")
    opened = sealed.select(
        s.aad().alias("aad"),
        s.unseal(F.col("c"), F.col("k"), s.aad()).alias("right"),
        s.unseal(F.col("c"), F.col("k"), F.lit("{}")).alias("other_aad"),
        s.unseal(F.col("c"), F.unhex(F.lit("00" * 32)), s.aad()).alias("other_key"),
        F.length("c").alias("n"),
    ).first()
    assert opened.aad == '{"client_id":"client_1","counter":1,"type":"model_update"}'
    assert (opened.right, opened.other_aad, opened.other_key, opened.n) == ("hello", None, None, 12 + 5 + 16)


def test_tamper_is_seen(spark):
    df = spark.createDataFrame([("a", 1)], "client_id string, x int").withColumn("text", s.canonical_json(["x", "client_id"]))
    df = df.withColumn("d", s.digest(F.col("text")))
    assert df.first().text == '{"client_id":"a","x":1}'
    assert msg.verify_digest(df, "text", "d").first().intact
    assert not msg.verify_digest(df.withColumn("text", F.replace("text", F.lit("1"), F.lit("2"))), "text", "d").first().intact


def sequence(spark, rows, clients, registered, with_key):
    """Sealed messages from ``(seq, client, counter, damaged, forged)``, with registry and keys."""
    df = spark.createDataFrame(rows, "seq bigint, client_id string, counter bigint, damaged boolean, forged boolean")
    df = df.withColumn("payload", F.format_string("p%d", "seq"))
    keys = key_table(spark, clients)
    forged = keys.withColumn("tag_key", F.col("session_key"))
    sealed = msg.seal_messages(df.where("NOT forged"), keys).unionByName(msg.seal_messages(df.where("forged"), forged))
    cut = F.when(F.col("damaged"), F.expr("substring(sealed, 1, length(sealed) - 1)")).otherwise(F.col("sealed"))
    registry = spark.createDataFrame([(c,) for c in registered], "client_id string")
    return materialize(sealed.withColumn("sealed", cut), "sealed"), registry, key_table(spark, with_key)


def one_by_one(rows, registered, with_key):
    """The admission rule applied message after message."""
    last, out = {}, {}
    for seq, client, counter, damaged, forged in sorted(rows):
        counter = -1 if counter is None else counter
        if client not in registered:
            out[seq] = "unregistered_client"
        elif counter <= last.get(client, -1):
            out[seq] = "replay_detected"
        elif client not in with_key:
            out[seq] = "no_session_key"
        elif damaged:
            out[seq] = "decryption_failed"
        else:
            last[client] = counter
            out[seq] = "invalid_signature" if forged else "ok"
    return out


CLIENTS = ["hot", "b", "c", "stranger", "keyless"]
REGISTERED, WITH_KEY = set(CLIENTS) - {"stranger"}, set(CLIENTS) - {"keyless"}


def random_rows(n=600):
    rng = random.Random(4)
    rows = []
    for seq in range(n):
        client = "hot" if rng.random() < 0.5 else rng.choice(CLIENTS)
        counter = rng.choice([None, -3, seq // 3, seq // 2, rng.randrange(n)]) if rng.random() < 0.4 else seq // 2
        rows.append((seq, client, counter, rng.random() < 0.15, rng.random() < 0.15))
    return rows


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_admission_equals_one_by_one(spark, hot_rows):
    rows = random_rows()
    sealed, registry, keys = sequence(spark, rows, CLIENTS, REGISTERED, WITH_KEY)
    got = msg.admit(sealed, registry, keys, hot_rows)
    want = one_by_one(rows, REGISTERED, WITH_KEY)
    assert set(want.values()) == set(msg.STATUSES)
    assert {r.seq: r.status for r in got.collect()} == want
    assert as_set(got.where("payload IS NOT NULL"), "seq", "payload") == {(k, f"p{k}") for k, v in want.items() if v == "ok"}
    assert not {"_key", "session_key", "tag_key", "_inner", "_outer", "sealed"} & set(got.columns)
    counts = as_set(msg.admission_summary(got), "client_id", "status", "n_messages")
    assert sum(n for *_, n in counts) == len(rows)


def test_what_uses_up_a_counter(spark):
    rows = [
        (0, "b", 5, True, False),  # undecryptable: counter stays free
        (1, "b", 5, False, True),  # wrong tag: counter is used
        (2, "b", 5, False, False),
        (3, "b", 6, False, False),
        (4, "c", 0, False, False),  # first counter may be 0
        (5, "c", 0, False, False),
        (6, "c", None, False, False),
    ]
    got = msg.admit(*sequence(spark, rows, ["b", "c"], ["b", "c"], ["b", "c"]))
    assert [r.status for r in got.orderBy("seq").collect()] == [
        "decryption_failed", "invalid_signature", "replay_detected", "ok", "ok", "replay_detected", "replay_detected",
    ]


def test_packages_without_payload_or_json(spark):
    """What decrypts to JSON uses up its counter even if nothing in it is authentic; other text does not."""
    keys = key_table(spark, ["b"])
    rows = [(0, "b", 3, "not json"), (1, "b", 3, "{}"), (2, "b", 3, '{"payload":"x"}'), (3, "b", 4, '{"payload":"x","digest":"y"}')]
    df = spark.createDataFrame(rows, "seq bigint, client_id string, counter bigint, text string")
    sealed = df.join(keys, "client_id").withColumn("sealed", s.seal(F.col("text"), F.col("session_key"), s.aad()))
    sealed = materialize(sealed.drop("text", "session_key", "tag_key"), "odd")
    got = msg.admit(sealed, keys.select("client_id"), keys)
    assert [r.status for r in got.orderBy("seq").collect()] == [
        "decryption_failed", "invalid_signature", "replay_detected", "invalid_signature",
    ]


def test_registering_again_restarts_the_counter(spark):
    registry = spark.createDataFrame([("a", 1, "k1", 40), ("b", 2, "k2", 7)], "client_id string, seq bigint, public_key string, last_counter bigint")
    new = spark.createDataFrame([("a", 5, "k5"), ("a", 4, "k4"), ("c", 6, "k6")], "client_id string, seq bigint, public_key string")
    got = as_set(msg.register(new, registry), "client_id", "seq", "public_key", "last_counter")
    assert got == {("a", 5, "k5", -1), ("b", 2, "k2", 7), ("c", 6, "k6", -1)}


def test_counters_continue(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, "a")], "seq bigint, client_id string")
    stored = spark.createDataFrame([("a", 10)], "client_id string, counter bigint")
    assert as_set(msg.next_counter(rows), "seq", "counter") == {(1, 1), (2, 1), (3, 2), (9, 3)}
    assert as_set(msg.next_counter(rows, stored, hot_rows=1), "seq", "counter") == {(1, 11), (2, 1), (3, 12), (9, 13)}


def test_registered_and_unregistered_parts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq bigint, client_id string")
    registry = spark.createDataFrame([("a",), ("z",)], "client_id string")
    assert as_set(msg.keep_registered(rows, registry), "seq") == {(1,), (3,)}
    assert as_set(msg.reject_unregistered(rows, registry), "seq") == {(2,)}


def test_stream_admission_survives_restarts(spark):
    rows = random_rows(300)
    sealed, registry, keys = sequence(spark, rows, CLIENTS, REGISTERED, WITH_KEY)
    sealed = sealed.withColumn("client_id", F.nullif("client_id", F.lit("stranger")))
    source, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "check"))
    for low in range(0, 300, 60):
        sealed.where(F.col("seq").between(low, low + 59)).write.mode("append").parquet(source)
        stream_admit(read_event_stream(spark, source, sealed.schema), registry, keys, out, checkpoint)
    got = spark.read.schema("seq bigint, client_id string, counter bigint, last_counter bigint, status string, payload string").parquet(out)
    want = msg.admit(sealed, registry, keys).select("seq", "client_id", "counter", "last_counter", "status", "payload")
    assert {r.seq: r.status for r in got.collect()} == one_by_one(rows, REGISTERED, WITH_KEY)
    seen = F.col("status") == "ok"  # a stream counts what it has seen; of others the payload stays hidden
    assert as_set(got.where(seen), *want.columns) == as_set(want.where(seen), *want.columns)
    assert got.where(~seen & F.col("payload").isNotNull()).count() == 0 and got.count() == 300


def test_stream_admission_calls_its_state_once_a_bucket(spark):
    rows = [(i, f"c{i % 4000}", i // 4000, True, True, True, i % 7 != 0, "p") for i in range(12_000)]
    calls, state = [], {}

    class Held:
        def __init__(self, key):
            self.key = key

        def exists(self):
            calls.append(self.key)
            return self.key in state

        def get(self):
            return state[self.key]

        def update(self, value):
            state[self.key] = value

    class Timer:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

    names = ["seq", "client_id", "sent", "registered", "has_key", "opened", "authentic", "payload"]
    pdf = pd.DataFrame(rows, columns=names).sample(frac=1, random_state=1).assign(counted=True)
    pdf["client"] = "k" + pdf["client_id"]

    def run(part, ttl=None, now=0):
        admission, timer = keyed.Admission(ttl), Timer()
        admission.counters, timer.now = Held(0), now
        return pd.concat(admission.handleInputRows((0,), iter([part]), timer))

    got = pd.concat([run(pdf[pdf["seq"] < 6_000]), run(pdf[pdf["seq"] >= 6_000])])
    assert len(calls) == 2 and len(got) == 12_000
    assert {s: n for s, n in got["status"].value_counts().items()} == {"ok": 10_285, "invalid_signature": 1_715}
    assert (got["last_counter"] == got["seq"] // 4000 - 1).all()
    assert set(run(pdf, now=10)["status"]) == {"replay_detected"}
    state.clear()
    run(pdf[pdf["client_id"] == "c1"], 100, 0), run(pdf[pdf["client_id"] == "c2"], 100, 60)
    again = run(pdf[pdf["client_id"].isin(["c1", "c2"])], 100, 110)  # c1 was silent for longer than the time to live
    assert set(again[again["client_id"] == "c2"]["status"]) == {"replay_detected"} and "replay_detected" not in set(again[again["client_id"] == "c1"]["status"])
