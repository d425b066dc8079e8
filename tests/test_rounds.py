import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set, gradient, key_table
from veilframe.functions.paillier import generate_keypair
from veilframe.plans import rounds
from veilframe.plans.rounds import RoundConfig, run_rounds
from veilframe.storage import names_in, new_path

LR, L2 = 0.5, 1e-4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3))
    return x, (x @ [2.0, -1.0, 0.5] > 0.1).astype(int), np.array([f"c{i}" for i in rng.integers(3, size=150)])


@pytest.fixture(scope="module")
def train(spark, data):
    x, y, c = data
    rows = [(i, str(c[i]), int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_key bigint, client_id string, y int, f_0 double, f_1 double, f_2 double").cache()


def expected(data, rounds, how="fedavg"):
    x, y, c = data
    w, models = np.zeros(4), []
    for _ in range(rounds):
        local = {k: np.array(gradient(x[c == k], y[c == k], w[:3], w[3], LR, L2, 1)) for k in sorted(set(c))}
        weights = [(c == k).sum() for k in local]
        values = np.array(list(local.values()))
        w = np.average(values, axis=0, weights=weights) if how == "fedavg" else np.median(values, axis=0)
        models.append(w)
    return models


def model_at(result, round):
    rows = result.models.where(F.col("round") == round).collect()
    return [r.value for r in sorted(rows, key=lambda r: (r.param, r.idx))]


@pytest.mark.parametrize("how", ["fedavg", "median"])
def test_plain_rounds_equal_numpy(data, train, how):
    result = run_rounds(train, train, RoundConfig(rounds=3, lr=LR, l2=L2, privacy=False, how=how))
    want = expected(data, 3, how)
    for i, w in enumerate(want, 1):
        assert model_at(result, i) == pytest.approx(w)
    x, y, _ = data
    last = {r["round"]: r.accuracy for r in result.metrics.collect()}[3]
    assert last == pytest.approx(((x @ want[-1][:3] + want[-1][3] > 0) == y).mean())
    assert result.ledger is None and result.admissions is None


def test_sealed_and_encrypted_rounds_equal_plain_ones(spark, data, train):
    clients = ["c0", "c1", "c2"]
    registry = spark.createDataFrame([(c,) for c in clients], "client_id string")
    config = RoundConfig(rounds=2, lr=LR, l2=L2, privacy=False, key=generate_keypair(512, seed=3))
    result = run_rounds(train, train, config, registry, key_table(spark, clients))
    assert model_at(result, 2) == pytest.approx(expected(data, 2)[-1])
    assert as_set(result.admissions, "round", "client_id", "status") == {(r, c, "ok") for r in (1, 2) for c in clients}
    assert all(r.communication_size_bytes > 100 for r in result.metrics.collect())


def test_rejected_updates_are_left_out_and_reported(spark, data, train):
    x, y, c = data
    registry = spark.createDataFrame([("c0",), ("c1",)], "client_id string")
    config = RoundConfig(rounds=1, lr=LR, l2=L2, privacy=False)
    result = run_rounds(train, train, config, registry, key_table(spark, ["c0", "c1", "c2"]))
    known = c != "c2"
    assert model_at(result, 1) == pytest.approx(expected((x[known], y[known], c[known]), 1)[-1])
    assert ("c2", "unregistered_client") in as_set(result.admissions, "client_id", "status")


def test_private_rounds_are_repeatable_with_a_seed_and_accounted(train):
    config = RoundConfig(rounds=2, lr=LR, seed=5, clip=0.5)
    one, two = (run_rounds(train, train, config) for _ in range(2))
    assert model_at(one, 2) == model_at(two, 2)
    other = run_rounds(train, train, RoundConfig(rounds=2, lr=LR, clip=0.5))
    assert model_at(one, 2) != model_at(other, 2)
    assert as_set(one.ledger.groupBy("client_id").agg(F.sum("epsilon").alias("e")), "client_id", "e") == {(f"c{i}", 20.0) for i in range(3)}
    assert one.released.where("noise <> 0").count() == 2 * 3 * 4


def test_sgd_rounds_learn(train):
    result = run_rounds(train, train, RoundConfig(rounds=3, solver="sgd", lr=0.1, privacy=False))
    assert max(r.accuracy for r in result.metrics.collect()) > 0.9


def test_the_median_of_ciphertexts_is_refused(train):
    with pytest.raises(ValueError):
        run_rounds(train, train, RoundConfig(how="median", key=generate_keypair(512, seed=3)))


def test_a_run_goes_on_from_the_counters_of_the_registry(spark, train):
    clients = ["c0", "c1", "c2"]
    registry = spark.createDataFrame([("c0", 5), ("c1", -1), ("c2", None)], "client_id string, last_counter bigint")
    result = run_rounds(train, train, RoundConfig(rounds=2, lr=LR, privacy=False), registry, key_table(spark, clients))
    assert as_set(result.admissions, "round", "client_id", "counter", "status") == {
        (r, c, r + (5 if c == "c0" else 0), "ok") for r in (1, 2) for c in clients
    }


@pytest.mark.parametrize("seed", [5, None])
def test_a_run_that_dies_goes_on_after_its_last_round(spark, train, monkeypatch, seed):
    """Ended at every table and note in turn, always with the same folder."""
    clients = [f"c{i}" for i in range(3)]
    registry = spark.createDataFrame([(c,) for c in clients], "client_id string")
    config, folder = RoundConfig(rounds=2, lr=LR, seed=seed, clip=0.5), new_path(spark, "log")
    run = lambda **more: run_rounds(train, train, config, registry, key_table(spark, clients), **more)
    keep, commit, calls, deaths = rounds._keep, rounds.commit_text, 0, 0

    def dies(at, what):
        def step(*args):
            nonlocal calls
            calls += 1
            if calls > at:
                raise OSError("lost")
            return what(*args)

        return step

    result = None
    while result is None:
        calls = 0
        with monkeypatch.context() as m:  # every attempt gets further by one step of the round that is open
            done = len(names_in(spark, f"{folder}/notes"))
            limit = deaths % 8 + 2
            m.setattr(rounds, "_keep", dies(limit, keep))
            m.setattr(rounds, "commit_text", dies(limit, commit))
            try:
                result = run(log=folder)
            except OSError:
                deaths += 1
        assert len(names_in(spark, f"{folder}/notes")) >= done and deaths < 40
    assert deaths >= 7
    assert [r["round"] for r in result.metrics.orderBy("round").collect()] == [1, 2]
    assert as_set(result.ledger, "client_id", "round") == {(c, r) for c in clients for r in (1, 2)} and result.ledger.count() == 6
    assert as_set(result.admissions, "round", "client_id", "status") == {(r, c, "ok") for r in (1, 2) for c in clients}
    if seed is not None:
        whole = run()
        assert as_set(result.models, "round", "param", "idx", "value") == as_set(whole.models, "round", "param", "idx", "value")
        assert as_set(result.released, "round", "client_id", "param", "idx", "noise") == as_set(whole.released, "round", "client_id", "param", "idx", "noise")
    again = run(log=folder)  # nothing is left to do
    assert as_set(again.models, "round", "param", "idx", "value") == as_set(result.models, "round", "param", "idx", "value")
    with pytest.raises(ValueError):
        run_rounds(train, train, RoundConfig(rounds=2, lr=LR / 2), registry, key_table(spark, clients), log=folder)
