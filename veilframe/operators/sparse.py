"""Training and scoring on sparse rows, for categoricals of any number of levels.

A row is ``x``, an array of ``(idx, value)`` for its numeric columns and for the one level each categorical has; a level without a position, the
first one of its column, has none. Scaling never fills in the zeros: z = (x - mean) / scale is linear, so the scale goes into the weight and
the mean into the bias, and a gradient needs the error-weighted sums over non-zeros and the summed error alone. Models and statistics are
tables by ``idx``; up to ``LITERAL`` weights are put into the plan, more are joined by position. Results equal those of the dense operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import literal_array, sigmoid
from veilframe.skew import attach
from veilframe.storage import materialize, materialize_counted

LITERAL = 4_096


def sparse_rows(df: DataFrame, dictionary: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep.., x``; ``dictionary`` as ``onehot_fit`` gives it, with the numeric columns at 0, 1, ... before it.

    Every categorical finds its level's position by a join of its own, so rows stay rows. NULL and unknown levels have no entry.
    """
    rows, at = df, []
    for i, c in enumerate(categorical):
        levels = dictionary.where(F.col("feature") == c).select(F.col("level").alias(f"_l{i}"), F.col("idx").alias(f"_i{i}"))
        rows = attach(rows.withColumn(f"_l{i}", F.col(f"`{c}`").cast("string")), levels, [f"_l{i}"], "left")
        at.append(F.struct(F.col(f"_i{i}").cast("int").alias("idx"), F.lit(1.0).alias("value")))
    numbers = [F.struct(F.lit(i).alias("idx"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(numeric)]
    return rows.select(*keep, F.filter(F.array(*numbers, *at), lambda e: e["idx"].isNotNull()).alias("x"))


def sparse_scale_fit(train: DataFrame) -> DataFrame:
    """``(idx, mean, scale)`` of every position that occurs: population standard deviation, 1 for a constant.

    Only non-zeros are added up; the zeros between them enter by their number.
    """
    n = train.count()
    if not n:
        raise ValueError("no rows to fit the scaling on")
    seen = train.select(F.explode("x").alias("e")).groupBy("e.idx").agg(
        F.count("e.value").alias("k"), F.avg("e.value").alias("m"), F.var_pop("e.value").alias("v")
    )
    share = F.col("k") / F.lit(float(n))
    deviation = F.sqrt(F.col("v") * share + F.col("m") * F.col("m") * share * (1 - share))
    scale = F.when(deviation == 0, 1.0).otherwise(deviation)
    return materialize(seen.select("idx", (F.col("m") * share).alias("mean"), scale.alias("scale")), "scaling")


def _folded(model: DataFrame, stats: DataFrame | None) -> tuple[DataFrame, int, float, float]:
    """``(idx, value, mean, scale, w)`` with the weight ``w`` of an unscaled feature, its rows, the bias, and the bias of unscaled rows."""
    weights = model.where("param = 'W'").select("idx", "value")
    if stats is None:
        weights = weights.withColumns({"mean": F.lit(0.0), "scale": F.lit(1.0)})
    else:
        weights = attach(weights, stats, ["idx"], "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "scale": F.coalesce("scale", F.lit(1.0))})
    table, d = materialize_counted(weights.withColumn("w", F.col("value") / F.col("scale")), "weights")
    bias = float(model.where("param = 'b'").first()["value"])
    return table, d, bias, bias - (table.agg(F.sum(F.col("w") * F.col("mean"))).first()[0] or 0.0)


def _margins(rows: DataFrame, weights: DataFrame, d: int, bias: float, key: str) -> DataFrame:
    """``rows`` with ``_margin``; NULL where a value is."""
    if d <= LITERAL:
        held = {r.idx: r.w for r in weights.select("idx", "w").collect()}
        values = literal_array([held.get(i, 0.0) for i in range(max(held, default=-1) + 1)])
        return rows.withColumn(
            "_margin", F.aggregate("x", F.lit(bias), lambda m, e: m + F.coalesce(F.get(values, e["idx"]), F.lit(0.0)) * e["value"])
        )
    others = [c for c in rows.columns if c not in (key, "x")]
    entries = rows.select(key, *others, F.explode_outer("x").alias("e")).withColumn("idx", F.col("e.idx"))
    met = attach(entries, weights.select("idx", "w"), ["idx"], "left", written=False)
    part = F.when(F.col("idx").isNull(), 0.0).otherwise(F.coalesce("w", F.lit(0.0)) * F.col("e.value"))
    whole = F.when(F.count(part) == F.count(F.lit(1)), F.sum(part) + F.lit(bias))
    return met.groupBy(key).agg(*[F.first(c).alias(c) for c in others], F.collect_list("e").alias("x"), whole.alias("_margin"))


def sparse_gradient_step(
    samples: DataFrame,
    model: DataFrame,
    stats: DataFrame | None = None,
    lr: float = 0.01,
    l2: float = 1e-4,
    key: str = "row_key",
    client: str = "client_id",
    label: str = "y",
) -> DataFrame:
    """``local_gradient_step`` on sparse rows, as if they had been scaled by ``stats``; ``key`` identifies a row.

    The errors and their sums are one aggregation by client and position, partial in every task; position -1 counts the rows.
    """
    weights, d, bias, shifted = _folded(model, stats)
    rows = _margins(samples.select(key, client, label, "x"), weights, d, shifted, key)
    rows = rows.withColumn("_err", sigmoid(F.col("_margin")) - F.col(label)).where("_err IS NOT NULL")
    one = F.array(F.struct(F.lit(-1).alias("idx"), F.lit(1.0).alias("value")))
    owner = F.struct(F.col(client).alias("key")).alias("_c")  # a NULL client is one like any other
    entries = rows.select(owner, "_err", F.explode(F.concat("x", one)).alias("e"))
    sums = entries.groupBy("_c", "e.idx").agg(F.sum(F.col("_err") * F.col("e.value")).alias("_g"), F.count(F.lit(1)).alias("num_samples"))
    sums = materialize(sums, "gradients")
    totals = sums.where("idx = -1").select("_c", F.col("_g").alias("_gb"), "num_samples")
    n, rate = F.col("num_samples"), F.lit(lr)
    every = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(d, 1) - 1))).alias("idx")).where(F.lit(d > 0))
    met = attach(every.join(sums.where("idx >= 0").select("_c", "idx", "_g"), ["_c", "idx"], "left"), weights, ["idx"], written=False)
    gradient = (F.coalesce("_g", F.lit(0.0)) - F.col("mean") * F.col("_gb")) / F.col("scale")
    moved = met.select("_c", F.lit("W").alias("param"), "idx", (F.col("value") * F.lit(1.0 - lr * l2) - rate * (gradient / n)).alias("value"), "num_samples")
    biases = totals.select("_c", F.lit("b").alias("param"), F.lit(0).alias("idx"), (F.lit(bias) - rate * (F.col("_gb") / n)).alias("value"), "num_samples")
    return moved.unionByName(biases).select(F.col("_c.key").alias(client), "param", "idx", "value", "num_samples")


def sparse_predict(samples: DataFrame, model: DataFrame, stats: DataFrame | None = None, key: str = "row_key", name: str = "prediction") -> DataFrame:
    """``predict`` on sparse rows, as if they had been scaled by ``stats``."""
    weights, d, _, shifted = _folded(model, stats)
    margin: Column = F.col("_margin")
    return _margins(samples, weights, d, shifted, key).withColumn(name, (margin > 0).cast("int")).drop("_margin")
