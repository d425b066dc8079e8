"""Differential privacy on long updates ``(round, client_id, param, idx, value, ...)`` and the budget ledger."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.functions.noise import draw, gaussian, laplace, noise_scale, privacy_level
from veilframe.skew import attach, running
from veilframe.storage import materialize

TENSOR = ("round", "client_id", "param")


def update_delta(local: DataFrame, model: DataFrame, on: Sequence[str] = ("param", "idx")) -> DataFrame:
    """``delta = value - global_value``. An element the model does not know is an error."""
    start = model.select(*on, F.col("value").alias("global_value"))
    joined = attach(local, start, on, "left")
    known = F.coalesce(
        F.col("global_value"),
        F.raise_error(F.concat_ws(" ", F.lit("update has an element unknown to the model:"), *on)).cast("double"),
    )
    return joined.withColumn("global_value", known).withColumn("delta", F.col("value") - F.col("global_value"))


def l2_norm(updates: DataFrame, value: str = "value", by: Sequence[str] = TENSOR) -> DataFrame:
    """Euclidean norm per tensor."""
    return updates.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def clip_factor(norm: Column, bound: float) -> Column:
    """Multiplier that brings ``norm`` down to ``bound``; 1.0 up to and including the bound."""
    return F.when(norm > bound, F.lit(float(bound)) / norm).otherwise(F.lit(1.0))


def clip_l2(updates: DataFrame, bound: float, value: str = "value", by: Sequence[str] = TENSOR) -> DataFrame:
    """Adds ``norm``, ``factor`` and ``clipped`` per element; every tensor is clipped on its own."""
    norms = l2_norm(updates, value, by).withColumn("factor", clip_factor(F.col("norm"), bound))
    return attach(updates, norms, by, null_safe=True).withColumn("clipped", F.col(value) * F.col("factor"))


def clip_tensors(
    updates: DataFrame, bound: float, value: str = "value", by: Sequence[str] = TENSOR, tensor: str = "param"
) -> DataFrame:
    """Smallest factor applied to any tensor of an update, with the number of clipped tensors."""
    group = [c for c in by if c != tensor]
    factors = l2_norm(updates, value, by).withColumn("factor", clip_factor(F.col("norm"), bound))
    return factors.groupBy(*group).agg(
        F.min("factor").alias("min_factor"),
        F.sum((F.col("factor") < 1.0).cast("bigint")).alias("clipped_tensors"),
    )


def add_gaussian(df: DataFrame, value: str, scale: Column, keys: Sequence[str], seed: int | str, name: str = "noisy") -> DataFrame:
    return df.withColumn(name, F.col(value) + gaussian(scale, seed, keys))


def add_laplace(df: DataFrame, value: str, scale: Column, keys: Sequence[str], seed: int | str, name: str = "noisy") -> DataFrame:
    return df.withColumn(name, F.col(value) + laplace(scale, seed, keys))


def add_noise_tensors(
    updates: DataFrame,
    mechanism: str | Column,
    epsilon,
    delta=1e-5,
    sensitivity=1.0,
    seed: int | str | None = None,
    value: str = "value",
    keys: Sequence[str] = (*TENSOR, "idx"),
    name: str = "noisy",
) -> DataFrame:
    """Noise on every element of every tensor; without ``seed`` a fresh one is drawn and forgotten."""
    seed = secrets.token_hex(16) if seed is None else seed
    scale = noise_scale(mechanism, epsilon, delta, sensitivity)
    return updates.withColumn(name, F.col(value) + draw(mechanism, scale, seed, keys))


def privatize_updates(
    local: DataFrame,
    model: DataFrame,
    bound: float,
    epsilon,
    delta=1e-5,
    mechanism: str = "gaussian",
    seed: int | str | None = None,
    on: Sequence[str] = ("param", "idx"),
    enabled: bool = True,
) -> DataFrame:
    """Clip each tensor's change to ``bound``, add noise for sensitivity ``bound``, return ``model + noisy change``.

    The result is written before use: evaluating it again must not release a second draw. ``noise`` stays in the table
    for reports and must not leave the trusted side.
    """
    if not enabled:
        return local
    clipped = clip_l2(update_delta(local, model, on), bound, "delta")
    noisy = add_noise_tensors(clipped, mechanism, epsilon, delta, bound, seed, "clipped", name="noisy")
    released = noisy.select(
        *[c for c in local.columns if c != "value"],
        (F.col("global_value") + F.col("noisy")).alias("value"),
        (F.col("noisy") - F.col("clipped")).alias("noise"),
        "factor",
    )
    return materialize(released, "private")


# ---- budget ledger: one row per client update ----


def account_steps(
    updates: DataFrame, epsilon, delta: float, mechanism: str, sensitivity: float = 1.0, epoch: int = 0
) -> DataFrame:
    """Ledger rows for a round: one per client update, however many tensors it has."""
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    return updates.groupBy("client_id", "round").agg(F.countDistinct("param").alias("tensors")).select(
        "client_id",
        F.lit(epoch).alias("epoch"),
        F.col("round").cast("bigint").alias("seq"),
        "round",
        eps.alias("epsilon"),
        F.lit(delta).alias("delta"),
        F.lit(mechanism).alias("mechanism"),
        F.lit(float(sensitivity)).alias("sensitivity"),
        "tensors",
    )


def spent_so_far(ledger: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Running ``spent`` and ``steps`` of each client within its epoch."""
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    return running(
        ledger,
        ["client_id", "epoch"],
        "seq",
        {"spent": ("sum", F.col("epsilon")), "steps": ("count", F.lit(1))},
        **options,
    )


def budget_totals(ledger: DataFrame) -> DataFrame:
    """Spent budget and steps per client and epoch."""
    return ledger.groupBy("client_id", "epoch").agg(
        F.sum("epsilon").alias("spent"), F.count(F.lit(1)).alias("steps")
    )


def current_epoch(ledger: DataFrame) -> DataFrame:
    """Rows of each client's latest epoch; a reset starts a new epoch and keeps the history."""
    latest = ledger.groupBy("client_id").agg(F.max("epoch").alias("epoch"))
    return attach(ledger, latest, ["client_id", "epoch"], "left_semi")


def reset_budget(ledger: DataFrame) -> DataFrame:
    """Epoch every client writes to after a reset: one row per client with nothing spent."""
    return ledger.groupBy("client_id").agg((F.max("epoch") + 1).alias("epoch")).select(
        "client_id", "epoch", F.lit(0.0).alias("spent"), F.lit(0).cast("bigint").alias("steps")
    )


def set_budget(ledger: DataFrame, config: DataFrame, keys: Sequence[str] = (), value: str = "epsilon") -> DataFrame:
    """Replace ``value`` by the latest configured one with ``valid_from <= round``; earlier rounds keep their own.

    ``config`` holds ``(keys.., valid_from, value)``. Each distinct round carries the last change at or before it, so
    steps meet changes by equality and never by range.
    """
    keys = list(keys)
    asked = ledger.select(*keys, F.col("round").alias("_at")).distinct()
    changes = config.select(*keys, F.col("valid_from").alias("_at"), F.struct(F.col(value).alias("v")).alias("_set"))
    # distinct rounds and changes only; a change goes before the round it is valid from
    order = W.partitionBy(*keys).orderBy("_at", F.col("_set").isNull()).rowsBetween(W.unboundedPreceding, 0)
    known = asked.unionByName(changes, allowMissingColumns=True).withColumn("_last", F.last("_set", ignorenulls=True).over(order))
    lookup = known.where(F.col("_set").isNull()).select(*keys, F.col("_at").alias("round"), F.col("_last.v").alias("_configured"))
    joined = attach(ledger, lookup, [*keys, "round"], "left")
    return joined.withColumn(value, F.coalesce("_configured", value)).drop("_configured").select(*ledger.columns)


def with_scale(ledger: DataFrame, sensitivity: float | Column = 1.0) -> DataFrame:
    """Noise scale of each step under its own budget and mechanism."""
    return ledger.withColumn(
        "scale", noise_scale(F.col("mechanism"), F.col("epsilon"), F.col("delta"), sensitivity)
    )


def privacy_report(ledger: DataFrame, sensitivity: float = 1.0, tensors: int = 2) -> DataFrame:
    """Per client: latest per-step budget, mechanism, scale and strength; totals of the latest epoch.

    ``eps_basic_composition`` is the spend when each noised tensor of a step is charged on its own. Sensitivity and tensors are
    the ledger's; the arguments stand in where it has no such column.
    """
    given = {"sensitivity": F.lit(float(sensitivity)), "tensors": F.lit(tensors)}
    steps = ledger.withColumns({c: v for c, v in given.items() if c not in ledger.columns})
    latest = F.max_by(F.struct("epsilon", "delta", "mechanism", "sensitivity"), F.col("seq"))
    composed = F.sum(F.col("epsilon") * F.col("tensors")).alias("composed")
    epochs = steps.groupBy("client_id", "epoch").agg(latest.alias("l"), F.sum("epsilon").alias("spent"), F.count(F.lit(1)).alias("steps"), composed)
    report = epochs.groupBy("client_id").agg(F.max_by(F.struct("l", "spent", "steps", "composed"), "epoch").alias("t"))
    report = report.select("client_id", "t.l.*", "t.spent", "t.steps", "t.composed")
    return with_scale(report, F.col("sensitivity")).select(
        "client_id",
        F.col("epsilon").alias("epsilon_per_round"),
        F.col("spent").alias("total_privacy_spent"),
        F.col("steps").alias("rounds_executed"),
        "delta",
        F.col("mechanism").alias("noise_mechanism"),
        F.col("scale").alias("noise_scale"),
        privacy_level(F.col("epsilon")).alias("privacy_level"),
        F.col("composed").alias("eps_basic_composition"),
    )


def record_rounds(
    metrics: DataFrame, ledger: DataFrame, released: DataFrame, client: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per round: budget, accuracy, spend of the representative client, mean absolute noise.

    ``metrics(round, accuracy)``, ``ledger`` and ``released(round, noise)``; the representative is the client with the
    smallest id unless named. ``by`` names further columns of ``metrics`` to keep, such as the run.
    """
    noise = released.groupBy("round").agg(F.avg(F.abs("noise")).alias("noise_magnitude"))
    if client is None:
        client = ledger.agg(F.min("client_id")).first()[0]
    own = spent_so_far(ledger.where(F.col("client_id") == F.lit(client)))
    steps = own.groupBy("round").agg(F.max("epsilon").alias("epsilon"), F.max("spent").alias("privacy_spent"))
    return (
        metrics.select(*by, "round", "accuracy")
        .join(steps, "round", "left")
        .join(noise, "round", "left")
        .select(*by, "round", "epsilon", "accuracy", "privacy_spent", F.coalesce("noise_magnitude", F.lit(0.0)).alias("noise_magnitude"))
    )


def tradeoff(recorded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last accuracy, the drop, and what it cost; under two rounds only a status is given."""
    stats = recorded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rounds_executed"),
        F.min_by("accuracy", "round").alias("initial_accuracy"),
        F.max_by("accuracy", "round").alias("final_accuracy"),
        F.max_by("privacy_spent", F.when(F.col("privacy_spent").isNotNull(), F.col("round"))).alias("total_privacy_budget_spent"),
        F.avg("noise_magnitude").alias("avg_noise_magnitude"),
        F.max("noise_magnitude").alias("max_noise_magnitude"),
    )
    enough = F.col("rounds_executed") >= 2
    drop = F.col("initial_accuracy") - F.col("final_accuracy")

    def when_enough(col: Column) -> Column:
        return F.when(enough, col)

    return stats.select(
        *by,
        F.when(enough, "ok").otherwise("Not enough data").alias("status"),
        "rounds_executed",
        *[
            when_enough(F.col(c)).alias(c)
            for c in (
                "initial_accuracy",
                "final_accuracy",
                "total_privacy_budget_spent",
                "avg_noise_magnitude",
                "max_noise_magnitude",
            )
        ],
        when_enough(drop).alias("accuracy_drop"),
        when_enough(F.try_divide(drop * 100.0, F.col("initial_accuracy"))).alias("accuracy_drop_percentage"),
    )
