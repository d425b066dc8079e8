"""Logistic model per client: initial parameters, training steps, scoring, accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.functions.numeric import UNROLL, dot, linear, literal_array, sigmoid
from veilframe.operators.index import hash_assign, hash_counts
from veilframe.operators.prep import drop_incomplete, feature_columns
from veilframe.skew import attach
from veilframe.storage import materialize, materialize_counted, new_path

MARGINS = 4_000_000  # scores held at once while evaluating many models


def init_model(spark: SparkSession, d: int, round: int = 0) -> DataFrame:
    """Zero weights ``W[0..d-1]`` and bias ``b[0]`` in long form."""
    weights = spark.range(d).select(F.lit("W").alias("param"), F.col("id").cast("int").alias("idx"))
    bias = spark.range(1).select(F.lit("b").alias("param"), F.col("id").cast("int").alias("idx"))
    return weights.unionByName(bias).select(F.lit(round).alias("round"), "param", "idx", F.lit(0.0).alias("value"))


def param_shapes(d: int) -> dict[str, tuple[int, ...]]:
    return {"W": (1, d), "b": (1,)}


def current_model(models: DataFrame) -> DataFrame:
    """Parameters of the latest round."""
    latest = models.agg(F.max("round")).first()[0]
    return models.where(F.col("round") == F.lit(latest))


def model_vector(model: DataFrame) -> tuple[list[float], float]:
    """Weights and bias of one model on the driver; d+1 numbers."""
    rows = model.select("param", "idx", "value").collect()
    weights = {r.idx: r.value for r in rows if r.param == "W"}
    return [weights[i] for i in range(len(weights))], next(r.value for r in rows if r.param == "b")


def as_wide(samples: DataFrame, array_col: str, d: int) -> DataFrame:
    """One double column per array element."""
    rest = [c for c in samples.columns if c != array_col]
    return samples.selectExpr(*rest, *[f"CAST({array_col}[{i}] AS DOUBLE) AS f_{i}" for i in range(d)])


def local_gradient_step(
    samples: DataFrame,
    model: DataFrame,
    lr: float = 0.01,
    l2: float = 1e-4,
    steps: int = 1,
    array_col: str | None = None,
    client: str = "client_id",
    label: str = "y",
) -> DataFrame:
    """Full-batch logistic gradient steps of every client from the shared model.

    Returns ``(client_id, param, idx, value, num_samples)``. The first step inlines the model as literals; every step
    is one aggregation with map-side partial sums, so the size of a client does not matter. Later steps join each
    client's own parameters.
    """
    w, b = model_vector(model)
    if array_col is None or len(w) > UNROLL:
        rows, x = samples, array_col
    else:
        rows, x = as_wide(samples, array_col, len(w)), None
    if x:
        shared = dot(literal_array(w), F.col(x)) + F.lit(b)
    else:
        shared = linear(w, feature_columns(rows), b)
    start = [literal_array(w).alias("_w"), F.lit(float(b)).alias("_b")]
    totals = _error_sums(rows, shared, x, client, label)
    out = _move(totals.select("*", *start), lr, l2, client)
    for _ in range(steps - 1):
        own = materialize(client_arrays(materialize(out, "local"), client), "arrays")
        features = F.col(x) if x else F.array(*feature_columns(rows))
        totals = _error_sums(attach(rows, own, [client]), dot(F.col("_w"), features) + F.col("_b"), x, client, label)
        out = _move(attach(totals, own, [client]), lr, l2, client)
    return out


def _error_sums(rows: DataFrame, margin: Column, x: str | None, client: str, label: str) -> DataFrame:
    """Per client the row count, the summed error ``_gb`` and the error-weighted feature sums ``_g``."""
    # a row with a NULL label or feature has no error: it is left out of the sums and the count, whatever the width
    rows = rows.withColumn("_err", sigmoid(margin) - F.col(label)).where("_err IS NOT NULL")
    features = [] if x else feature_columns(rows)
    if x or len(features) > UNROLL:
        values = F.transform(F.col(x) if x else F.array(*features), lambda v: v.cast("double") * F.col("_err"))
        grads = vector_to_array(Summarizer.sum(array_to_vector(values)))
    else:
        grads = F.expr(f"array({', '.join(f'sum(_err * {c})' for c in features)})")
    return rows.groupBy(client).agg(F.sum("_err").alias("_gb"), F.count(F.lit(1)).alias("num_samples"), grads.alias("_g"))


def _stepped(n: Column, lr: float, l2: float) -> Column:
    """``_w`` after a step along ``_g``, the gradients summed over ``n`` rows."""
    return F.zip_with("_w", "_g", lambda w, g: w * F.lit(1.0 - lr * l2) - F.lit(lr) * (g / n))


def _move(totals: DataFrame, lr: float, l2: float, client: str) -> DataFrame:
    """One gradient step from ``_w`` and ``_b``, as long updates; the bias is not penalised."""
    n = F.col("num_samples")
    return _long(totals, F.concat(_stepped(n, lr, l2), F.array(F.col("_b") - F.lit(lr) * (F.col("_gb") / n))), client)


def _long(rows: DataFrame, params: Column, client: str) -> DataFrame:
    """``(client_id, param, idx, value, num_samples)`` of weights followed by the bias."""
    long = rows.select(client, "num_samples", F.size("_w").alias("_d"), F.posexplode(params).alias("_at", "value"))
    is_weight = F.col("_at") < F.col("_d")
    return long.select(
        client,
        F.when(is_weight, "W").otherwise("b").alias("param"),
        F.when(is_weight, F.col("_at")).otherwise(0).alias("idx"),
        "value",
        "num_samples",
    )


def client_arrays(updates: DataFrame, client: str = "client_id") -> DataFrame:
    """One row per client with its weight array ``_w`` and bias ``_b``; a group holds one model."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("param") == "W", F.struct("idx", "value"))))
    return updates.groupBy(client).agg(
        F.transform(ordered, lambda e: e["value"]).alias("_w"),
        F.max(F.when(F.col("param") == "b", F.col("value"))).alias("_b"),
    )


def local_sgd_epoch(
    samples: DataFrame,
    model: DataFrame,
    key: str = "row_key",
    lr: float = 0.01,
    l2: float = 1e-4,
    seed: int = 42,
    steps: int = 8,
    client: str = "client_id",
    label: str = "y",
) -> DataFrame:
    """One epoch of mini-batch SGD for each client: ``steps`` batches of its rows in hash order, each a step from the one before.

    Row i of a client's n complete rows belongs to batch i * steps div n, so batches differ by one row at most, whatever the client's
    size; a client of fewer rows than steps has batches of one row and empty ones, which move nothing. Rows are written once by batch. A
    step reads its batch only, adds up gradients per client before the shuffle, and writes every client's parameters for the next
    one: no client and no batch is ever gathered in a task, and a lost executor repeats one step at most.
    """
    if steps < 1:
        raise ValueError(f"an epoch of {steps} steps")
    spark, features = samples.sparkSession, feature_columns(samples)
    w, b = model_vector(model)
    rows = drop_incomplete(samples.select(client, key, label, *features), [label, *features])
    counts = hash_counts(rows, seed, key, by=[client]).withColumn("_total", F.sum("_n").over(W.partitionBy(client)))

    def batch(position: Column) -> Column:
        return F.call_function("div", position * F.lit(steps), F.col("_total")).cast("int")

    path = new_path(spark, "batches")
    placed = hash_assign(rows, key, counts, batch, "_batch", seed, by=[client]).drop(key)
    placed.write.partitionBy("_batch").parquet(path)
    batches = spark.read.schema(placed.schema).parquet(path)
    sizes = counts.groupBy(client).agg(F.sum("_n").alias("num_samples"))
    now = materialize(sizes.select(client, "num_samples", literal_array(w).alias("_w"), F.lit(float(b)).alias("_b")), "parameters")
    for step in range(steps):
        part = attach(batches.where(F.col("_batch") == step), now.drop("num_samples"), [client], null_safe=True, written=False)
        margin = dot(F.col("_w"), F.array(*features)) + F.col("_b")
        sums = _error_sums(part, margin, None, client, label).withColumnRenamed("num_samples", "_rows")
        moved = attach(now, sums, [client], "left", null_safe=True, written=False)
        w_new = F.when(F.col("_rows").isNull(), F.col("_w")).otherwise(_stepped(F.col("_rows"), lr, l2))
        b_new = F.when(F.col("_rows").isNull(), F.col("_b")).otherwise(F.col("_b") - F.lit(lr) * (F.col("_gb") / F.col("_rows")))
        now = materialize(moved.select(client, "num_samples", w_new.alias("_w"), b_new.alias("_b")), "parameters")
    return _long(now, F.concat("_w", F.array("_b")), client)


def predict(samples: DataFrame, model: DataFrame, array_col: str | None = None, name: str = "prediction") -> DataFrame:
    """Class 1 when ``w.x + b > 0``."""
    w, b = model_vector(model)
    if array_col:
        margin = dot(literal_array(w), F.col(array_col)) + F.lit(b)
    else:
        margin = linear(w, feature_columns(samples), b)
    return samples.withColumn(name, (margin > 0).cast("int"))


def accuracy(pred: DataFrame, by: list[str] | None = None, label: str = "y") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
    return pred.groupBy(*(by or [])).agg(hit, F.count(F.lit(1)).alias("n_rows"))


def evaluate_clients(
    test: DataFrame,
    client_models: DataFrame,
    array_col: str | None = None,
    label: str = "y",
    client: str = "client_id",
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """Accuracy of every client's model on the shared test rows, as a blocked matrix product.

    Test rows and models are cut into blocks of about ``block_bytes``. Every two blocks meet by key in a task's group of their own, are
    multiplied there and leave one hit counter per model, which are added up: no model comes to the driver, no row and model meet as a pair.
    """
    arrays, n_models = materialize_counted(client_arrays(client_models, client), "models")
    if not n_models:
        return arrays.select(client, F.lit(0.0).alias("accuracy"), F.lit(0).cast("bigint").alias("n_rows"))
    d = arrays.select(F.size("_w")).first()[0]
    per_block = max(1, block_bytes // (8 * (d + 1)))
    x = F.col(array_col) if array_col else F.array(*feature_columns(test))
    rows = test.select(x.cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    row_blocks, model_blocks = max(1, -(-rows.count() // per_block)), -(-n_models // per_block)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)).alias("_t"), every(model_blocks).alias("_m"), "x", "y")
    right = arrays.select(every(row_blocks).alias("_t"), F.pmod(F.xxhash64(client), F.lit(model_blocks)).alias("_m"), client, F.concat("_w", F.array("_b")).alias("_p"))
    kind = client_models.schema[client].dataType.simpleString()
    met = left.groupBy("_t", "_m").cogroup(right.groupBy("_t", "_m"))
    hits = met.applyInArrow(_multiply(client, d), f"{client} {kind}, hits bigint, n bigint")
    return hits.groupBy(client).agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy"), F.sum("n").alias("n_rows"))


def _multiply(client: str, d: int):
    """Hits of a block of models on a block of rows."""

    def values(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def count(rows: pa.Table, models: pa.Table) -> pa.Table:
        params, hits = values(models.column("_p"), d + 1), np.zeros(models.num_rows, np.int64)
        if rows.num_rows and models.num_rows:
            x, positive = values(rows.column("x"), d), rows.column("y").to_numpy() == 1
            step = max(1, MARGINS // models.num_rows)
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                hits += ((x[part] @ params[:, :-1].T + params[:, -1] > 0) == positive[part][:, None]).sum(axis=0)
        n = np.full(models.num_rows, rows.num_rows, np.int64)
        return pa.table({client: models.column(client), "hits": hits, "n": n})

    return count
