"""Folds over the event feed ``(ts, seq, client_id, kind, value)``; ``seq`` is the arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.operators.metrics import fixed_text
from veilframe.storage import materialize

# Client states, threat levels and their events.
CLIENT_STATES = ("TRAINING", "ENCRYPTING", "SENT", "READY")
IDLE = "IDLE"
CALM = "LOW"
THREAT_LEVELS = {"threat_quantum": "CRITICAL", "threat_mitm": "HIGH", "reset": CALM}
# Lines shown to people.
RESET_LINE = "Pipeline reset. Ready for new training."
QUANTUM_LINE = "QUANTUM WAVEFRONT DETECTED"
MITM_LINE = "PACKET INTERCEPTED"


def threat_level(kind: Column) -> Column:
    """Level an event sets; NULL when it leaves the level alone."""
    level = F.lit(None).cast("string")
    for name, value in THREAT_LEVELS.items():
        level = F.when(kind == name, value).otherwise(level)
    return level


def severity(feed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest level, LOW before any event."""
    level = threat_level(F.col("kind"))
    latest = F.max_by(level, F.when(level.isNotNull(), F.col("seq")))
    return feed.groupBy(*by).agg(F.coalesce(latest, F.lit(CALM)).alias("threat_level"))


def status_state(feed: DataFrame) -> DataFrame:
    """Per client the last state event; resets and states sent to everybody are kept under a NULL client.

    A plain grouped aggregate, so the same expression runs on a stream.
    """
    is_state = F.col("kind").isin(*CLIENT_STATES)
    is_reset = F.col("kind") == "reset"
    at_state = F.when(is_state, F.col("seq"))
    return feed.withColumn("client_id", F.when(~is_reset, F.col("client_id"))).groupBy("client_id").agg(
        F.max(F.when(is_reset, F.col("seq"))).alias("reset_seq"),
        F.max(at_state).alias("seq"),
        F.max_by(F.when(is_state, F.col("kind")), at_state).alias("status"),
        F.max_by(F.when(is_state, F.col("value")), at_state).alias("value"),
    )


def resolve_status(state: DataFrame) -> DataFrame:
    """Status and last value per client: its own or a broadcast state, whichever is later; IDLE and 0 after a reset."""
    shared = state.where("client_id IS NULL")

    def of_all(column: str, default: object) -> Column:
        return F.coalesce(shared.select(column).scalar(), F.lit(default))  # a subquery of the same plan

    reset, sent_at, own = of_all("reset_seq", -1), of_all("seq", -1), F.coalesce("seq", F.lit(-1))
    live = own > reset
    status = F.when((sent_at > reset) & (own <= sent_at), shared.select("status").scalar()).when(live, F.col("status")).otherwise(IDLE)
    return state.where("client_id IS NOT NULL").select(
        "client_id", status.alias("status"), F.when(live, F.col("value")).otherwise(0.0).alias("value")
    )


def client_status(feed: DataFrame) -> DataFrame:
    return resolve_status(materialize(status_state(feed), "status"))


def status_snapshot(feed: DataFrame, rounds: DataFrame, config: DataFrame, metrics: DataFrame, num_features: int) -> DataFrame:
    """One row: current round, threat level, clients, budget, features and accuracy history length.

    ``config(valid_from, epsilon)`` holds budget changes, ``metrics(round, accuracy)`` finished rounds.
    """
    level = threat_level(F.col("kind"))
    one = feed.agg(
        F.coalesce(F.max_by(level, F.when(level.isNotNull(), F.col("seq"))), F.lit(CALM)).alias("threat_level"),
        F.countDistinct("client_id").alias("num_clients"),
    )
    round_no = rounds.where("kind = 'round_start'").agg(F.max("round")).scalar()
    return one.select(
        F.coalesce(round_no, F.lit(0)).cast("int").alias("round"),
        "threat_level",
        "num_clients",
        config.agg(F.max_by("epsilon", "valid_from")).scalar().cast("double").alias("epsilon"),
        metrics.agg(F.count(F.lit(1))).scalar().cast("bigint").alias("rounds_done"),
        metrics.agg(F.max_by("accuracy", "round")).scalar().cast("double").alias("last_accuracy"),
        F.lit(num_features).alias("num_features"),
    )


def last_n(events: DataFrame, n: int = 40, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """The latest ``n`` rows, or of each key; both forms cut to ``n`` per task before the shuffle."""
    if not by:
        return events.orderBy(F.desc(order)).limit(n)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))
    return events.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def log_lines(feed: DataFrame) -> DataFrame:
    """``(seq, text, type)`` for people."""
    kind = F.col("kind")
    text = (
        F.when(kind == "reset", RESET_LINE)
        .when(kind == "threat_quantum", QUANTUM_LINE)
        .when(kind == "threat_mitm", MITM_LINE)
        .when(
            kind == "READY",
            F.concat(F.lit("["), F.col("client_id"), F.lit("] Acc: "), fixed_text(F.col("value"), 1), F.lit("%")),
        )
        .otherwise(F.concat(F.lit("["), F.col("client_id"), F.lit("] "), kind))
    )
    level = F.when(kind == "reset", "success").when(kind.startswith("threat_"), "warn").otherwise("info")
    return feed.select("seq", text.alias("text"), level.alias("type"))


def round_lines(metrics: DataFrame) -> DataFrame:
    """One line per finished round."""
    text = F.concat(
        F.lit("Round "), F.col("round").cast("string"), F.lit(" Global Accuracy: "),
        fixed_text(F.col("accuracy") * F.lit(100.0), 2), F.lit("%"),
    )
    return metrics.select("run", "round", text.alias("text"), F.lit("success").alias("type"))


def rounds_from_events(events: DataFrame) -> DataFrame:
    """Start, end and duration of each round; a round without its closing event is 'aborted'."""
    spans = events.groupBy("round").agg(
        F.min(F.when(F.col("kind") == "round_start", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("kind") == "round_complete", F.col("ts"))).alias("ended"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended")) / F.lit(1e6)
    return spans.select(
        "round", "started", "ended", seconds.alias("seconds"),
        F.when(F.col("ended").isNull(), "aborted").otherwise("completed").alias("status"),
    )
