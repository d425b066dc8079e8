"""Shapes of plans that matter at scale."""

import re

from pyspark.sql import functions as F

from veilframe.operators import combine as cb
from veilframe.operators import metrics as mt
from veilframe.operators import model as md
from veilframe.operators import privacy as dp
from veilframe.operators import status as st
from veilframe.plans import fixtures as fx
from veilframe.plans import registry as rg

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan(df)))


def test_aggregations_combine_before_their_only_shuffle(spark):
    updates = spark.range(100).selectExpr(
        "1 AS round", "'W' AS param", "CAST(id % 4 AS INT) AS idx", "concat('c', id) AS client_id", "rand(1) AS value", "id + 1 AS num_samples"
    )
    for df in (cb.fedavg(updates), cb.median_update(updates), dp.l2_norm(updates), cb.element_counts(updates)):
        assert shuffles(df) == 1 and "partial_" in plan(df)


def test_a_training_step_is_one_shuffle_of_partial_sums(spark):
    samples = spark.range(100).selectExpr("id AS row_key", "CAST(id % 2 AS INT) AS y", "id % 3 AS client_id", "rand(1) AS f_0", "rand(2) AS f_1")
    step = md.local_gradient_step(samples, md.init_model(spark, 2))
    assert "partial_sum" in plan(step) and "Python" not in plan(step) and "Join" not in plan(step)
    assert shuffles(step) == 1 and plan(step).count("Range ") == 1


def test_clipping_does_not_move_the_updates(spark):
    updates = spark.range(100).selectExpr("1 AS round", "'W' AS param", "CAST(id AS INT) AS idx", "'a' AS client_id", "rand(1) AS value")
    assert shuffles(dp.clip_l2(updates, 1.0)) == 0


def test_scans_read_only_what_they_need(spark):
    rows = mt.round_metrics(fx.view(spark, SF_DIR, fx.MEASUREMENTS))
    assert "user_id" not in plan(rows) and "event_id" not in plan(rows)
    text = plan(rg.QUERIES["source_samples"](spark, SF_DIR).where("c_acctbal > 0").select("c_custkey", "c_acctbal"))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in text
    assert "c_mktsegment" not in text


def test_latest_rows_are_cut_in_every_task(spark):
    feed = fx.view(spark, SF_DIR, fx.FEED).select("seq", "client_id", "kind")
    assert "TakeOrderedAndProject" in plan(st.last_n(feed))
    assert "WindowGroupLimit" in plan(st.last_n(feed, 5, ["client_id"]))


def test_noise_and_sealing_stay_in_the_jvm(spark):
    for name in ("dp_gaussian", "dp_laplace", "msg_tag", "msg_admit", "msg_replay"):
        text = plan(rg.QUERIES[name](spark, SF_DIR))
        assert "Python" not in text and "Arrow" not in text and "InPandas" not in text


def test_a_long_model_is_scored_with_arrays(spark):
    d = 400
    rows = spark.range(5).select("id", *[(F.col("id") * 0.1 + i).alias(f"f_{i}") for i in range(d)])
    model = md.init_model(spark, d).withColumn("value", F.lit(0.5))
    want = [1 if sum(0.5 * (k * 0.1 + i) for i in range(d)) + 0.5 > 0 else 0 for k in range(5)]
    assert [r.prediction for r in md.predict(rows, model).orderBy("id").select("prediction").collect()] == want
