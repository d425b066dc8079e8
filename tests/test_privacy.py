import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.functions.noise import gaussian, laplace, noise_scale, privacy_level
from veilframe.operators import privacy as dp

UPDATE = "round int, client_id string, param string, idx int, value double, num_samples bigint"


def tensor(spark, *clients):
    rows = [(1, c, p, i, float(v), 1) for c, tensors in clients for p, values in tensors.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, UPDATE)


def test_clip_boundaries(spark):
    df = tensor(spark, ("at", {"W": [3, 4]}), ("above", {"W": [6, 8]}), ("zero", {"W": [0, 0]}), ("near", {"W": [5.000001]}))
    got = {r.client_id: r for r in dp.clip_l2(df, 5.0).where("idx = 0").collect()}
    assert got["at"].factor == 1.0 and got["zero"].factor == 1.0 and got["above"].factor == 0.5
    assert got["near"].factor < 1.0 and got["near"].clipped == pytest.approx(5.0)
    assert got["above"].clipped == 3.0


def test_smallest_factor_is_reported(spark):
    df = tensor(spark, ("a", {"W": [6, 8], "b": [1]}), ("b", {"W": [1], "b": [1]}))
    assert as_set(dp.clip_tensors(df, 5.0), "client_id", "min_factor", "clipped_tensors") == {("a", 0.5, 1), ("b", 1.0, 0)}


def test_scale_formulas(spark):
    row = spark.range(1).select(
        noise_scale("laplace", 0.5, sensitivity=2.0).alias("l"), noise_scale("gaussian", 1.0, 1e-5, 1.0).alias("g")
    ).first()
    assert row.l == 4.0 and row.g == pytest.approx(math.sqrt(2 * math.log(1.25e5)))
    with pytest.raises(ValueError, match="no such noise mechanism"):
        noise_scale("uniform", 1.0)
    with pytest.raises(Exception, match="no such noise mechanism: other"):
        spark.range(1).select(noise_scale(F.lit("other"), 1.0)).collect()


def test_privacy_bands(spark):
    edges = [0.05, 0.1, 0.5, 1.0, 5.0, 10.0]
    got = spark.createDataFrame([(e,) for e in edges], "e double").select("e", privacy_level(F.col("e")).alias("t")).collect()
    words = ["Extremely Strong", "Very Strong", "Strong", "Moderate", "Weak", "Very Weak"]
    assert [r.t.split(" (")[0] for r in sorted(got)] == words


@pytest.mark.parametrize("make,cdf", [
    (gaussian, lambda x, s: 0.5 * (1 + np.vectorize(math.erf)(x / s / math.sqrt(2)))),
    (laplace, lambda x, s: np.where(x < 0, 0.5 * np.exp(x / s), 1 - 0.5 * np.exp(-np.abs(x) / s))),
])
def test_noise_has_its_distribution_and_ignores_partitioning(spark, make, cdf):
    df = spark.range(40_000).selectExpr("id AS k", "'W' AS param")
    noisy = [
        {r.k: r.z for r in df.repartition(n).select("k", make(F.lit(2.0), 9, ["param", "k"]).alias("z")).collect()}
        for n in (1, 7)
    ]
    assert noisy[0] == noisy[1]
    z = np.sort(list(noisy[0].values()))
    assert len(np.unique(z)) == len(z)
    ranks = np.arange(1, len(z) + 1) / len(z)
    assert np.max(np.abs(cdf(z, 2.0) - ranks)) < 1.63 / math.sqrt(len(z))  # KS at 1 %
    other = df.select(make(F.lit(2.0), 10, ["param", "k"]).alias("z")).collect()
    assert abs(np.corrcoef([noisy[0][i] for i in range(len(other))], [r.z for r in other])[0, 1]) < 0.03


def test_privatize_clips_adds_noise_once_and_reads_back_the_same(spark):
    model = spark.createDataFrame([("W", 0, 1.0), ("W", 1, 1.0), ("b", 0, 0.5)], "param string, idx int, value double")
    local = tensor(spark, ("a", {"W": [4.0, 5.0], "b": [0.6]}))
    sent = dp.privatize_updates(local, model, 1.0, 1e9)
    got = {(r.param, r.idx): r for r in sent.collect()}
    assert got["W", 0].value == pytest.approx(1 + 0.6, abs=1e-6) and got["b", 0].value == pytest.approx(0.6, abs=1e-6)
    assert got["W", 0].factor == pytest.approx(0.2)
    assert {k: r.value for k, r in got.items()} == {(r.param, r.idx): r.value for r in sent.collect()}
    assert got["W", 0].noise != 0
    assert dp.privatize_updates(local, model, 1.0, 1.0, enabled=False) is local


def test_unknown_element_is_an_error(spark):
    model = spark.createDataFrame([("W", 0, 1.0)], "param string, idx int, value double")
    with pytest.raises(Exception, match="unknown to the model: W 1"):
        dp.update_delta(tensor(spark, ("a", {"W": [1, 2]})), model).collect()


def test_one_step_per_update_not_per_tensor(spark):
    updates = tensor(spark, ("a", {"W": [0] * 5, "b": [0]}))
    noisy = dp.add_noise_tensors(updates, "gaussian", 1.0, 1e-5, 1.0)
    ledger = dp.account_steps(noisy, 1.0, 1e-5, "gaussian")
    assert as_set(dp.budget_totals(ledger), "client_id", "spent", "steps") == {("a", 1.0, 1)}
    assert ledger.first().tensors == 2


LEDGER = "client_id string, epoch int, seq bigint, round int, epsilon double, delta double, mechanism string"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(c, e, 10 * e + r, 10 * e + r, 0.5 + r, 1e-5, "gaussian") for c in "ab" for e in (0, 1) for r in range(1, 6)]
    return spark.createDataFrame(rows, LEDGER)


@pytest.mark.parametrize("hot_rows", [100, 2])
def test_running_spend_restarts_with_an_epoch(ledger, hot_rows):
    got = as_set(dp.spent_so_far(ledger, hot_rows), "client_id", "seq", "spent", "steps")
    want = {(c, 10 * e + r, sum(0.5 + i for i in range(1, r + 1)), r) for c in "ab" for e in (0, 1) for r in range(1, 6)}
    assert got == want


def test_reset_keeps_history(ledger):
    assert as_set(dp.reset_budget(ledger), "client_id", "epoch", "spent", "steps") == {("a", 2, 0.0, 0), ("b", 2, 0.0, 0)}
    assert dp.current_epoch(ledger).count() == 10


def test_budget_as_of(spark, ledger):
    config = spark.createDataFrame([(3, 0.1), (12, 7.0)], "valid_from int, epsilon double")
    got = {(r.client_id, r["round"]): r.epsilon for r in dp.set_budget(ledger, config).collect()}
    assert got["a", 2] == 2.5 and got["a", 3] == 0.1 and got["b", 11] == 0.1 and got["b", 12] == 7.0
    own = spark.createDataFrame([("a", 3, 0.1)], "client_id string, valid_from int, epsilon double")
    got = {(r.client_id, r["round"]): r.epsilon for r in dp.set_budget(ledger, own, ["client_id"]).collect()}
    assert got["a", 15] == 0.1 and got["b", 15] == 5.5 and len(got) == 20


def test_report(ledger):
    r = dp.privacy_report(ledger, 2.0).where("client_id = 'a'").first()
    assert (r.epsilon_per_round, r.total_privacy_spent, r.rounds_executed) == (5.5, 17.5, 5)
    assert r.noise_scale == pytest.approx(math.sqrt(2 * math.log(1.25e5)) * 2 / 5.5)
    assert r.privacy_level.startswith("Weak") and r.eps_basic_composition == 35.0


RECORDED = "round int, accuracy double, privacy_spent double, noise_magnitude double"


def test_tradeoff_needs_two_rounds(spark):
    none = dp.tradeoff(spark.createDataFrame([], RECORDED)).first()
    one = dp.tradeoff(spark.createDataFrame([(1, 0.5, 1.0, 0.1)], RECORDED)).first()
    assert none.status == one.status == "Not enough data" and one.final_accuracy is None
    two = dp.tradeoff(spark.createDataFrame([(2, 0.4, 2.0, 0.3), (1, 0.5, 1.0, 0.1)], RECORDED)).first()
    assert two.status == "ok" and two.accuracy_drop == pytest.approx(0.1) and two.accuracy_drop_percentage == pytest.approx(20)
    assert (two.total_privacy_budget_spent, two.avg_noise_magnitude, two.max_noise_magnitude) == (2.0, 0.2, 0.3)
    zero = dp.tradeoff(spark.createDataFrame([(1, 0.0, 1.0, 0.1), (2, 0.5, 2.0, 0.1)], RECORDED)).first()
    assert zero.accuracy_drop_percentage is None
