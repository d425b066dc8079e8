"""Sealing and admitting client messages: registration, replay rule, decryption, authenticity.

Messages are ``(seq, client_id, counter, sealed, ...)``; ``seq`` is a unique integer arrival number. A sealed text is
the package JSON ``{digest, payload, tag}``. Keys come as tables and never appear in an output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.sealing import (
    NO_COUNTER,
    aad,
    counter_or_default,
    digest,
    hmac_pads,
    seal,
    tag,
    unseal,
)
from veilframe.skew import attach, running

# The outcome of an admission, first failing check first.
STATUSES = (
    "unregistered_client",
    "replay_detected",
    "no_session_key",
    "decryption_failed",
    "invalid_signature",
    "ok",
)
PACKAGE = "payload string, digest string, tag string"


def register(registrations: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Registry after ``(client_id, seq, public_key)`` rows: the last registration wins and restarts its counter."""
    rows = registrations.select("client_id", "seq", "public_key")
    if registry is not None:
        old = registry.select("client_id", "seq", "public_key", "last_counter")
        rows = rows.withColumn("last_counter", F.lit(NO_COUNTER).cast("bigint")).unionByName(old)
    else:
        rows = rows.withColumn("last_counter", F.lit(NO_COUNTER).cast("bigint"))
    latest = F.max_by(F.struct("seq", "public_key", "last_counter"), "seq")
    return rows.groupBy("client_id").agg(latest.alias("r")).select("client_id", "r.*")


def reject_unregistered(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages of unknown clients."""
    return attach(messages, registry.select("client_id").distinct(), ["client_id"], "left_anti")


def keep_registered(messages: DataFrame, registry: DataFrame) -> DataFrame:
    return attach(messages, registry.select("client_id").distinct(), ["client_id"], "left_semi")


def last_counter(messages: DataFrame, advances: Column, hot_rows: int | None = None) -> DataFrame:
    """Adds ``last_counter``: the highest counter among earlier messages of the client that advanced it.

    Rows with a counter at or below the running maximum cannot raise it, so the maximum over all opened messages equals
    the rule "advance only on acceptance". Counters below -1 do not lower the start value.
    """
    counter = F.greatest(counter_or_default(), F.lit(NO_COUNTER).cast("bigint"))
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    seen = running(
        messages, ["client_id"], "seq", {"_seen": ("max", F.when(advances, counter))}, inclusive=False, **options
    )
    start = F.coalesce("start_counter", F.lit(NO_COUNTER)) if "start_counter" in messages.columns else F.lit(NO_COUNTER)
    last = F.greatest(F.coalesce("_seen", F.lit(NO_COUNTER)), start).cast("bigint")
    return seen.withColumn("last_counter", last).drop("_seen")


def reject_replays(messages: DataFrame, advances: Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """Adds ``last_counter`` and ``replayed``."""
    seen = last_counter(messages, F.lit(True) if advances is None else advances, hot_rows)
    return seen.withColumn("replayed", counter_or_default() <= F.col("last_counter"))


def _spread(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys dealt to the session's shuffle partitions outright: their pads cost far more than their few bytes tell."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def with_keys(messages: DataFrame, registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``_registered``, ``_key`` and the tag pads from the registry and the key table.

    ``keys`` holds ``(client_id, session_key binary, tag_key binary)``; both tables become one small row per client. Of several
    keys for a client the largest pair counts, so that a message always gets one verdict.
    """
    keys = keys.groupBy("client_id").agg(F.max(F.struct("session_key", "tag_key")).alias("k")).select("client_id", "k.*")
    keys = _spread(keys, ["client_id"])
    inner, outer = hmac_pads(F.col("tag_key"))
    known = registry.select("client_id").distinct().withColumn("_registered", F.lit(True))
    held = keys.select("client_id", F.col("session_key").alias("_key"), inner.alias("_inner"), outer.alias("_outer"))
    clients = known.join(held, "client_id", "full_outer")
    joined = attach(messages, clients, ["client_id"], "left", written=False)
    return joined.withColumn("_registered", F.coalesce("_registered", F.lit(False)))


def require_session(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages of clients without a session key."""
    return attach(messages, keys.select("client_id").distinct(), ["client_id"], "left_anti")


def seal_messages(
    messages: DataFrame, keys: DataFrame, payload: str = "payload", on: Sequence[str] = ("client_id",)
) -> DataFrame:
    """Digest, tag and encrypt each payload under the keys found by ``on``; adds ``sealed``, drops the payload."""
    inner, outer = hmac_pads(F.col("tag_key"))
    held = _spread(keys, on).select(*on, F.col("session_key").alias("_key"), inner.alias("_inner"), outer.alias("_outer"))
    rows = attach(messages, held, on, written=False)
    text = F.col(payload)
    package = F.to_json(
        F.struct(
            digest(text).alias("digest"), text.alias("payload"), tag(text, F.col("_inner"), F.col("_outer")).alias("tag")
        )
    )
    return rows.withColumn("sealed", seal(package, F.col("_key"), aad())).drop(payload, "_key", "_inner", "_outer")


def open_messages(keyed: DataFrame) -> DataFrame:
    """Adds ``payload``, ``opened`` and ``authentic`` to keyed messages.

    A message is opened when it decrypts to JSON; a package without payload is opened but not authentic.
    """
    opened = keyed.withColumn("_text", unseal(F.col("sealed"), F.col("_key"), aad()))
    opened = opened.withColumn("_p", F.from_json("_text", PACKAGE))
    is_json = F.when(F.col("_p.payload").isNotNull(), True).otherwise(F.get_json_object("_text", "$").isNotNull())
    return opened.select(
        "*",
        F.col("_p.payload").alias("payload"),
        is_json.alias("opened"),
        verified("_p", F.col("_inner"), F.col("_outer")).alias("authentic"),
    ).drop("_p", "_text")


def verified(package: str, inner: Column, outer: Column) -> Column:
    """Tag and digest both fit the payload; false when anything is missing."""
    text = F.col(f"{package}.payload")
    return F.coalesce(
        (tag(text, inner, outer) == F.col(f"{package}.tag")) & (digest(text) == F.col(f"{package}.digest")), F.lit(False)
    )


def verify_digest(df: DataFrame, payload: str, expected: str, name: str = "intact") -> DataFrame:
    return df.withColumn(name, F.coalesce(digest(F.col(payload)) == F.col(expected), F.lit(False)))


def decide(opened: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``status`` of opened messages: the first failing check, or 'ok'."""
    has_key, is_open = F.col("_key").isNotNull(), F.col("opened")
    judged = last_counter(opened, F.col("_registered") & has_key & is_open, hot_rows)
    checks = [
        ~F.col("_registered"),
        counter_or_default() <= F.col("last_counter"),
        ~has_key,
        ~is_open,
        ~F.col("authentic"),
    ]
    status = F.lit(STATUSES[-1])
    for failed, reason in reversed(list(zip(checks, STATUSES[:-1], strict=True))):
        status = F.when(failed, reason).otherwise(status)
    return judged.withColumn("status", status)


def admit(messages: DataFrame, registry: DataFrame, keys: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Messages with their ``status`` and, when accepted, their payload. ``start_counter`` may carry earlier state."""
    judged = decide(open_messages(with_keys(messages, registry, keys)), hot_rows)
    accepted = F.when(F.col("status") == "ok", F.col("payload"))
    hidden = {"_key", "_inner", "_outer", "_registered", "sealed", "payload", "opened", "authentic"}
    return judged.select(*[c for c in judged.columns if c not in hidden], accepted.alias("payload"))


def extract_updates(admitted: DataFrame, keep: Sequence[str] = ("seq", "client_id"), element: str = "double") -> DataFrame:
    """Accepted payloads ``{model_params: {param: [values]}, num_samples}`` as long updates.

    ``element`` is the values' type: double, or string for ciphertexts in wire form.
    """
    body = F.from_json("payload", f"num_samples bigint, model_params map<string, array<{element}>>")
    rows = admitted.where("status = 'ok'").select(*keep, body.alias("u"))
    params = rows.select(*keep, F.coalesce("u.num_samples", F.lit(0)).alias("num_samples"), F.explode("u.model_params").alias("param", "x"))
    return params.select(*keep, "num_samples", "param", F.posexplode("x").alias("idx", "value"))


def admission_summary(admitted: DataFrame) -> DataFrame:
    """Messages per client and outcome."""
    return admitted.groupBy("client_id", "status").agg(F.count(F.lit(1)).alias("n_messages"))


def next_counter(messages: DataFrame, stored: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Adds the sender's ``counter``: one more per message, from the last stored counter or 1."""
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    counted = running(messages, ["client_id"], "seq", {"counter": ("count", F.lit(1))}, **options)
    if stored is None:
        return counted
    base = stored.select("client_id", F.col("counter").alias("_base"))
    rows = attach(counted, base, ["client_id"], "left")
    return rows.withColumn("counter", F.col("counter") + F.coalesce("_base", F.lit(0))).drop("_base")


def payload_size(df: DataFrame, cols: Sequence[str], name: str = "size_bytes") -> DataFrame:
    """UTF-8 bytes of the JSON payload."""
    return df.withColumn(name, F.octet_length(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))).cast("bigint"))
