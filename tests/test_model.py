import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set, gradient
from veilframe.functions import numeric
from veilframe.operators import model as md


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + 0.3 * rng.normal(size=240) > 0).astype(int)
    return x, y, np.array([f"c{i % 3}" if i % 2 else "c0" for i in range(240)])


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y, c = data
    rows = [(i, str(c[i]), int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_key bigint, client_id string, y int, f_0 double, f_1 double, f_2 double, f_3 double").repartition(3)


def model_of(spark, w, b):
    rows = [("W", i, float(v)) for i, v in enumerate(w)] + [("b", 0, float(b))]
    return spark.createDataFrame(rows, "param string, idx int, value double")


def by_client(df, d):
    out = {}
    for r in df.collect():
        out.setdefault(r.client_id, [None] * (d + 1))[r.idx if r.param == "W" else d] = r.value
    return out


@pytest.mark.parametrize("steps", [1, 3])
@pytest.mark.parametrize("form", ["wide", "array", "long array"])
def test_gradient_steps(spark, data, samples, steps, form, monkeypatch):
    x, y, c = data
    w, b = np.array([0.1, 0.0, -0.2, 0.3]), 0.05
    if form == "long array":
        monkeypatch.setattr(md, "UNROLL", 2)
        monkeypatch.setattr(numeric, "UNROLL", 2)
    rows = samples if form == "wide" else samples.select("client_id", "y", F.array(*[f"f_{i}" for i in range(4)]).alias("x"))
    got = md.local_gradient_step(rows, model_of(spark, w, b), 0.5, 0.01, steps, None if form == "wide" else "x")
    want = {k: gradient(x[c == k], y[c == k], w, b, 0.5, 0.01, steps) for k in set(c)}
    for k, params in by_client(got, 4).items():
        assert params == pytest.approx(want[k])
    assert as_set(got, "client_id", "num_samples") == {(k, int((c == k).sum())) for k in want}


def hash_order(keys):
    import hashlib

    return sorted(keys, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())


def sgd(x, y, w, b, lr, l2, order, steps):
    w = np.array(w, dtype=float)
    for s in range(steps):
        i = [k for at, k in enumerate(order) if at * steps // len(order) == s]
        if i:
            err = 1 / (1 + np.exp(-(x[i] @ w + b))) - y[i]
            w, b = w * (1 - lr * l2) - lr * (err[:, None] * x[i]).mean(axis=0), b - lr * err.mean()
    return np.array([*w, b])


@pytest.mark.parametrize("partitions, steps", [(1, 1), (7, 5), (3, 90)])
def test_sgd_epoch_takes_batches_in_hash_order(spark, data, samples, partitions, steps):
    x, y, c = data
    rows = samples.withColumn("client_id", F.nullif("client_id", F.lit("c2"))).repartition(partitions)
    got = by_client(md.local_sgd_epoch(rows, model_of(spark, [0.1, 0, 0, 0], 0.2), lr=0.3, steps=steps), 4)
    for k in set(c):
        order = hash_order(np.flatnonzero(c == k))
        assert got[None if k == "c2" else k] == pytest.approx(sgd(x, y, [0.1, 0, 0, 0], 0.2, 0.3, 1e-4, order, steps))


def test_sgd_epoch_of_one_large_client_keeps_to_partial_sums(spark):
    rows = spark.range(200_000).selectExpr(
        "id AS row_key", "if(id % 10 = 0, 'small', 'large') AS client_id", "CAST(id % 2 AS INT) AS y", "if(id % 1000 = 7, NULL, id % 2 - 0.5D) AS f_0", "rand(3) AS f_1"
    )
    got = md.local_sgd_epoch(rows, md.init_model(spark, 2), lr=0.5, steps=4)
    assert as_set(got, "client_id", "num_samples") == {("small", 20_000), ("large", 180_000 - 200)}
    assert all(p[0] > 0.1 for p in by_client(got, 2).values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    with pytest.raises(ValueError):
        md.local_sgd_epoch(rows, md.init_model(spark, 2), steps=0)


def test_prediction_threshold_is_strict(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 1), (-1.0, 1)], "f_0 double, y int")
    scored = md.predict(rows, model_of(spark, [2.0], 0.0))
    assert as_set(scored, "f_0", "prediction") == {(0.0, 0), (1.0, 1), (-1.0, 0)}
    assert md.accuracy(scored).first().accuracy == pytest.approx(2 / 3)


@pytest.mark.parametrize("block_bytes", [32_000_000, 60])
def test_every_client_model_is_scored_on_all_rows(spark, data, samples, block_bytes, monkeypatch):
    x, y, _ = data
    monkeypatch.setattr(md, "MARGINS", 100)
    rng = np.random.default_rng(1)
    models = {f"m{i}": rng.normal(size=5) for i in range(6)}
    rows = [(k, "W" if i < 4 else "b", i % 4, float(v)) for k, p in models.items() for i, v in enumerate(p)]
    table = spark.createDataFrame(rows, "client_id string, param string, idx int, value double")
    got = {r.client_id: (r.accuracy, r.n_rows) for r in md.evaluate_clients(samples, table, block_bytes=block_bytes).collect()}
    assert got == {k: (pytest.approx(((x @ p[:4] + p[4] > 0) == y).mean()), 240) for k, p in models.items()}


def test_start_and_latest_model(spark):
    first = md.init_model(spark, 3)
    assert as_set(first, "param", "idx", "value") == {("W", 0, 0.0), ("W", 1, 0.0), ("W", 2, 0.0), ("b", 0, 0.0)}
    assert md.param_shapes(3) == {"W": (1, 3), "b": (1,)}
    both = first.unionByName(first.withColumn("round", F.lit(4)))
    assert as_set(md.current_model(both), "round") == {(4,)}
    with pytest.raises(ValueError):
        md.predict(spark.createDataFrame([(1.0,)], "f_0 double"), first)


def test_a_hundred_thousand_models(spark):
    n = 100_000
    models = spark.range(n).selectExpr("concat('c', id) AS client_id", "explode(array(named_struct('param', 'W', 'idx', 0, 'value', 1.0D), named_struct('param', 'b', 'idx', 0, 'value', -(id % 10) - 0.5D))) AS e")
    rows = spark.range(10).selectExpr("CAST(id AS DOUBLE) AS f_0", "1 AS y")
    got = md.evaluate_clients(rows, models.select("client_id", "e.*"), block_bytes=400_000)
    summary = got.groupBy("accuracy", "n_rows").count().collect()
    assert {(round(r.accuracy, 6), r.n_rows, r["count"]) for r in summary} == {((9 - i) / 10, 10, n // 10) for i in range(10)}
