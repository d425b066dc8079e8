"""Round metrics of training runs and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.functions.numeric import fixed

TIMES = ("training_time", "encryption_time", "aggregation_time")


def round_metrics(measurements: DataFrame) -> DataFrame:
    """Per run and round: mean accuracy, summed times and bytes of all clients, longest aggregation.

    ``measurements`` holds ``(run, round, accuracy, total_time, training_time, encryption_time, aggregation_time,
    communication_size_bytes)``, one row per measured client or step, NULL where a value does not apply.
    """
    return measurements.groupBy("run", "round").agg(
        F.avg("accuracy").alias("accuracy"),
        F.sum("total_time").alias("total_time"),
        F.sum("training_time").alias("training_time"),
        F.sum("encryption_time").alias("encryption_time"),
        F.max("aggregation_time").alias("aggregation_time"),
        F.sum("communication_size_bytes").cast("bigint").alias("communication_size_bytes"),
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row per run: last accuracy, mean round time, time sums, traffic."""
    volume = F.sum("communication_size_bytes")
    return metrics.groupBy("run").agg(
        F.max_by("accuracy", "round").alias("final_accuracy"),
        F.avg("total_time").alias("avg_round_time"),
        *[F.sum(t).alias(f"total_{t}") for t in TIMES],
        (volume / F.lit(1024.0 * 1024.0)).alias("total_communication_mb"),
        (volume / F.count(F.lit(1)) / F.lit(1024.0)).alias("avg_communication_per_round_kb"),
    )


def compare_runs(summary: DataFrame, baseline: str, other: str) -> DataFrame:
    """Differences and overheads of ``other`` against ``baseline`` in one pass; percent of zero is NULL."""

    def of(run: str, col: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col(col)))

    def difference(col: str) -> Column:
        return of(other, col) - of(baseline, col)

    def overhead(col: str) -> Column:
        return F.try_divide(difference(col) * F.lit(100.0), of(baseline, col))

    return summary.agg(
        difference("final_accuracy").alias("accuracy_difference"),
        overhead("avg_round_time").alias("time_overhead_percentage"),
        overhead("total_communication_mb").alias("communication_overhead_percentage"),
        difference("total_encryption_time").alias("encryption_overhead_seconds"),
    )


def time_breakdown(summary: DataFrame) -> DataFrame:
    """Stacked time segments: each starts where the one before ended."""
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(t.removesuffix("_time")).alias("segment"), F.col(f"total_{t}").alias("seconds"))
            for i, t in enumerate(TIMES)
        ]
    )
    rows = summary.select("run", F.explode(parts).alias("p")).select("run", "p.*")
    before = W.partitionBy("run").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)))


def series(metrics: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Accuracy, seconds and KB of the runs side by side per round."""
    return (
        metrics.groupBy("round")
        .pivot("run", list(runs))
        .agg(
            F.max("accuracy").alias("accuracy"),
            F.max("total_time").alias("seconds"),
            (F.max("communication_size_bytes") / F.lit(1024.0)).alias("kb"),
        )
    )


def accuracy_axis(metrics: DataFrame, pad: float = 0.05) -> DataFrame:
    """Axis bounds around all accuracies."""
    return metrics.agg(
        (F.min("accuracy") - F.lit(pad)).alias("axis_min"), (F.max("accuracy") + F.lit(pad)).alias("axis_max")
    )


def fixed_text(col: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded half up."""
    unit = 10**digits
    n = F.floor(F.abs(col) * F.lit(float(unit)) + F.lit(0.5)).cast("bigint")
    whole, part = F.floor(n / F.lit(unit)).cast("bigint"), n % F.lit(unit)
    sign = F.when((col < 0) & (n > 0), "-").otherwise("")
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))


def format_summary(summary: DataFrame, comparison: DataFrame, baseline: str, other: str) -> DataFrame:
    """Text table ``(ord, metric, baseline, other, overhead)``."""

    def of(run: str, col: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col(col)))

    # metric, source column, decimals, unit, overhead column, its decimals and unit
    lines = [
        ("Final Accuracy", "final_accuracy", 4, "", "accuracy_difference", 4, ""),
        ("Avg Round Time", "avg_round_time", 2, "s", "time_overhead_percentage", 1, "%"),
        ("Total Comm.", "total_communication_mb", 2, " MB", "communication_overhead_percentage", 1, "%"),
        ("Encryption Time", "total_encryption_time", 2, "s", "encryption_overhead_seconds", 2, "s"),
    ]
    wide = summary.agg(
        *[of(run, line[1]).alias(f"{side}_{i}") for i, line in enumerate(lines) for side, run in (("a", baseline), ("b", other))]
    )
    overheads = comparison.first()
    cells = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(name).alias("metric"),
            F.concat(fixed_text(F.col(f"a_{i}"), digits), F.lit(unit)).alias("baseline"),
            F.concat(fixed_text(F.col(f"b_{i}"), digits), F.lit(unit)).alias("other"),
            F.concat(fixed_text(F.lit(overheads[over]).cast("double"), over_digits), F.lit(over_unit)).alias("overhead"),
        )
        for i, (name, _, digits, unit, over, over_digits, over_unit) in enumerate(lines)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def accuracy_history(metrics: DataFrame) -> DataFrame:
    """Per run the rounds in order with accuracy at 4 decimals; a group holds one row per round."""
    point = F.struct("round", fixed("accuracy", 4).alias("accuracy"))
    return metrics.groupBy("run").agg(F.array_sort(F.collect_list(point)).alias("history"))
