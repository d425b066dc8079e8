"""Rows with NULL keys, labels, features or weights are kept or left out by one stated rule, never lost on the way."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.noise import uniform
from veilframe.functions.paillier import generate_keypair
from veilframe.operators import combine as cb
from veilframe.operators import encrypted as enc
from veilframe.operators import messages as msg
from veilframe.operators import model as md
from veilframe.operators import prep
from veilframe.operators import privacy as dp
from veilframe.operators.index import hash_index
from veilframe.sources.tables import read_samples

KEY = generate_keypair(512, seed=7)


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 > 0, (F.col("id") % 2).cast("int"))
    return spark.range(1000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("row_key"), label.alias("y"), "id")


def test_exact_split_and_clients_keep_rows_with_null_labels_and_keys(rows):
    assert prep.stratified_split(rows, "y", "row_key", exact=True).count() == 1000
    for strategy in ("iid", "non-iid"):
        sizes = prep.assign_clients(rows, 3, "row_key", strategy).groupBy("client_id").count().collect()
        assert sorted(r["count"] for r in sizes) == [333, 333, 334]
    placed = hash_index(rows, "row_key", by=["y"])
    assert placed.count() == 1000 and placed.groupBy("y", "position").count().where("count > 1").count() == 0


def test_clipping_keeps_updates_with_null_keys(spark):
    schema = "round int, client_id string, param string, idx int, value double"
    updates = spark.createDataFrame([(1, "a", "W", 0, 3.0), (None, "a", "W", 0, 4.0), (1, None, "W", 0, 0.5)], schema)
    assert sorted(r.clipped for r in dp.clip_l2(updates, 1.0).collect()) == [0.5, 1.0, 1.0]


@pytest.mark.parametrize("d", [3, 300])
def test_rows_with_null_features_count_nowhere_at_any_width(spark, d):
    data = [(0, 1, [1.0] * d), (0, 0, [2.0] * d), (0, 1, [None] + [1.0] * (d - 1)), (0, None, [1.0] * d)]
    samples = spark.createDataFrame(data, "client_id int, y int, x array<double>")
    model = md.init_model(spark, d)
    got = md.local_gradient_step(samples, model, lr=0.5, array_col="x")
    want = md.local_gradient_step(samples.limit(2), model, lr=0.5, array_col="x")
    pick = lambda df: {(r.param, r.idx): (r.value, r.num_samples) for r in df.collect()}
    assert pick(got) == pick(want) and pick(got)["b", 0][1] == 2


def test_no_models_give_no_accuracies(spark):
    test = spark.createDataFrame([(1.0, 1)], "f_0 double, y int")
    models = spark.createDataFrame([], "client_id string, param string, idx int, value double")
    assert md.evaluate_clients(test, models).collect() == []


def test_noise_keys_cannot_be_confused(spark):
    pairs = [("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None), ("-,", "x"), ("1:x,", ""), ("", "1:x,"), (None, None)]
    df = spark.createDataFrame(pairs, "p string, q string").withColumn("u", uniform(1, ["p", "q"]))
    assert len({r.u for r in df.collect()}) == len(pairs)


def test_encrypted_mean_refuses_what_the_plain_one_refuses(spark):
    rows = [(1, "a", "W", 0, 1.0, 10), (1, "b", "W", 0, 5.0, -5), (1, "c", "W", 0, 9.0, None), (1, "d", "W", 0, float("nan"), 3), (1, "e", "W", 0, None, 3), (1, "f", "W", 0, 4.0, 20)]
    df = spark.createDataFrame(rows, "round int, client_id string, param string, idx int, value double, num_samples long")
    keys = ["round", "param", "idx"]
    plain = cb.fedavg(cb.collect_updates(df)).first().value
    assert enc.he_fedavg(enc.he_encrypt(df, "value", KEY.public), keys, KEY).first().value == pytest.approx(plain) == 3.0


def test_partial_products_stay_one_per_group_and_task(spark):
    one = enc.he_encrypt(spark.range(1).select(F.lit(2.0).alias("value")), "value", KEY.public)
    many = spark.range(0, 9000, 1, 3).select((F.col("id") % 1500).alias("idx"), F.lit(1).cast("bigint").alias("num_samples")).crossJoin(F.broadcast(one))
    fold = enc._fold(many.select("idx", "cipher", "num_samples").schema, 1, KEY.public, True)
    rows = many.select("idx", "cipher", "num_samples").sortWithinPartitions("idx")
    assert rows.mapInArrow(fold, rows.schema).count() == 3 * 1500


def test_a_key_listed_twice_gives_one_verdict(spark):
    keys = spark.createDataFrame([("a", bytearray(b"1" * 32), bytearray(b"2" * 32)), ("a", bytearray(b"3" * 32), bytearray(b"4" * 32))], "client_id string, session_key binary, tag_key binary")
    messages = spark.createDataFrame([("a", 1), ("b", 1)], "client_id string, counter long")
    assert msg.with_keys(messages, messages.select("client_id"), keys).count() == 2


def test_report_takes_sensitivity_and_tensors_from_the_ledger(spark):
    updates = spark.createDataFrame([("a", 1, "W"), ("a", 1, "b"), ("b", 1, "W")], "client_id string, round int, param string")
    ledger = dp.account_steps(updates, 10.0, 1e-5, "gaussian", sensitivity=2.0)
    got = {r.client_id: (r.noise_scale, r.eps_basic_composition) for r in dp.privacy_report(ledger).collect()}
    plain = dp.privacy_report(ledger.drop("sensitivity", "tensors")).first().noise_scale
    assert got["a"] == (pytest.approx(2 * plain), 20.0) and got["b"][1] == 10.0


def test_budget_changes_without_keys_meet_no_range_join(spark):
    ledger = spark.createDataFrame([("a", r, 1.0) for r in range(1, 9)], "client_id string, round int, epsilon double")
    changes = spark.createDataFrame([(3, 5.0), (6, None), (7, 2.0)], "valid_from int, epsilon double")
    out = dp.set_budget(ledger, changes)
    assert [r.epsilon for r in out.orderBy("round").collect()] == [1, 1, 5, 5, 5, 1, 2, 2]


def test_a_damaged_file_is_one_runtime_error(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"PAR1 not a table PAR1")
    with pytest.raises(RuntimeError):
        read_samples(spark, str(tmp_path / "x.parquet"))
    with pytest.raises(RuntimeError):
        read_samples(spark, str(tmp_path / "none.parquet"))
