import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.operators import model as md
from veilframe.operators import prep
from veilframe.operators import sparse as sp

KEEP = ["row_key", "client_id", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).selectExpr(
        "id AS row_key", "if(id % 7 = 0, NULL, concat('c', id % 3)) AS client_id", "CAST((id * 7 + id % 5) % 2 AS INT) AS y",
        "IF(id = 13, NULL, CAST(id % 11 AS DOUBLE) * 1e4) AS a", "0.0D AS zero", "concat('l', id % 17) AS cat", "IF(id % 4 = 0, NULL, concat('m', id % 6)) AS other",
    )
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def encoded(rows):
    known = rows.where("a IS NOT NULL AND row_key < 390")
    levels = prep.onehot_fit(known.where("row_key % 17 <> 3"), ["cat", "other"], offset=2)  # 'l3' is a level nobody knows
    dense = prep.onehot_transform(rows, levels, ["a", "zero"], KEEP)
    return levels, dense, sp.sparse_rows(rows, levels, ["a", "zero"], ["cat", "other"], KEEP)


def values(df):
    return {(r.client_id, r.param, r.idx): (pytest.approx(r.value, rel=1e-9, abs=1e-12), r.num_samples) for r in df.collect()}


@pytest.mark.parametrize("literal", [4096, 0])
def test_steps_and_scores_equal_the_dense_ones(spark, encoded, monkeypatch, literal):
    monkeypatch.setattr(sp, "LITERAL", literal)
    levels, dense, sparse = encoded
    names = prep.feature_columns(dense)
    fitted = prep.scale_fit(dense.where("f_0 IS NOT NULL"), names)
    stats = sp.sparse_scale_fit(sparse.where("row_key <> 13"))
    for r in stats.collect():
        assert (r["mean"], r["scale"]) == pytest.approx(fitted[f"f_{r.idx}"])
    scaled = prep.scale_transform(dense, fitted)
    model = md.init_model(spark, len(names)).withColumn("value", (F.col("idx") % 5 - 2) / 7.0 + F.when(F.col("param") == "b", 0.3).otherwise(0.0))
    want, got = md.local_gradient_step(scaled, model, lr=0.4), sp.sparse_gradient_step(sparse, model, stats, lr=0.4)
    assert values(got) == values(want) and got.columns == want.columns
    scores = as_set(md.predict(scaled, model), "row_key", "prediction")
    assert as_set(sp.sparse_predict(sparse, model, stats), "row_key", "prediction") == scores and (13, None) in scores


def test_unscaled_rows_and_rows_without_entries(spark):
    rows = spark.createDataFrame([(1, "a", 1, []), (2, "a", 0, [(0, 2.0)])], "row_key long, client_id string, y int, x array<struct<idx:int,value:double>>")
    for d in (1, 5000):
        got = {(r.param, r.idx): r.value for r in sp.sparse_gradient_step(rows, md.init_model(spark, d), lr=1.0, l2=0.0).collect()}
        assert got["W", 0] == -0.5 and got["b", 0] == 0.0 and len(got) == d + 1


def test_a_hundred_thousand_levels(spark):
    n = 100_000
    df = spark.range(2 * n).selectExpr("id AS row_key", f"concat('level ', id % {n}) AS cat", f"CAST(id % {n} % 2 AS INT) AS y", "id % 2 AS client_id")
    levels = prep.onehot_fit(df, ["cat"])
    rows = sp.sparse_rows(df, levels, [], ["cat"], ["row_key", "y", "client_id"])
    model = md.init_model(spark, n - 1)
    local = sp.sparse_gradient_step(rows, model, lr=float(n))
    w = local.groupBy("param", "idx").agg(F.avg("value").alias("value"))
    scored = md.accuracy(sp.sparse_predict(rows, w)).first()
    assert local.count() == 2 * n and scored.n_rows == 2 * n and scored.accuracy > 0.99999


def test_scaling_needs_rows(encoded):
    with pytest.raises(ValueError):
        sp.sparse_scale_fit(encoded[2].limit(0))


def test_small_models_need_no_shuffle_of_rows(spark, encoded):
    model = md.init_model(spark, 30)
    plan = sp.sparse_predict(encoded[2], model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
    assert np.isfinite([r.value for r in sp.sparse_gradient_step(encoded[2], model).collect()]).all()
