import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.operators import prep
from veilframe.sources.tables import read_metrics, read_model, read_samples, write_metrics, write_model
from veilframe.operators.model import init_model
from veilframe.storage import new_path


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, 1.0, "a", "x", " >50K."),
        (2, 2.0, "?", "x", ">50K"),
        (3, None, "a", "y", "<=50K"),
        (4, 4.0, "b", " ?", "<=50K."),
        (5, 9.0, "B", "y", None),
        (6, 2.0, "c", None, ">50K"),
    ]
    return spark.createDataFrame(rows, "row_key bigint, num double, cat string, other string, label string")


def test_missing_marker_is_exact_and_rows_need_every_feature(raw):
    marked = prep.null_markers(raw, ["num", "cat", "other"])
    assert as_set(marked, "row_key", "cat", "other") >= {(2, None, "x"), (4, "b", " ?")}
    assert as_set(prep.drop_incomplete(marked, ["num", "cat", "other"]), "row_key") == {(1,), (4,), (5,)}


def test_label_forms(raw):
    assert as_set(prep.binary_label(raw, "label"), "row_key", "y") == {(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1)}


def test_resolve_keeps_candidate_order(raw):
    assert prep.resolve_features(raw, ["other", "absent", "num"]) == ["other", "num"]


def test_onehot_sorts_by_code_point_and_drops_the_first(spark, raw):
    rows = raw.where("cat <> '?'").na.fill({"other": "z"}).where("num IS NOT NULL")
    levels = prep.onehot_fit(rows, ["cat", "other"], offset=1)
    # code points: 'B' < 'a' < 'b' < 'c'; ' ?' < 'x' < 'y' < 'z'
    assert as_set(levels, "idx", "name") == {
        (1, "cat_a"), (2, "cat_b"), (3, "cat_c"), (4, "other_x"), (5, "other_y"), (6, "other_z"),
    }
    wide = prep.onehot_transform(rows, levels, ["num"], ["row_key"])
    got = {r.row_key: [r[c] for c in prep.feature_columns(wide)] for r in wide.collect()}
    assert got[1] == [1.0, 1, 0, 0, 1, 0, 0] and got[5] == [9.0, 0, 0, 0, 0, 1, 0]
    sparse = prep.onehot_sparse(rows, levels, ["cat", "other"], "row_key")
    assert as_set(sparse, "row_key", "idx") == {(k, i) for k, x in got.items() for i, v in enumerate(x) if i and v}


def test_onehot_of_long_level_tables(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS row_key", "concat('l', id % 97) AS a", "concat('m', id % 5) AS b", "'one' AS c")
    small = as_set(prep.onehot_fit(rows, ["a", "b", "c"]), "idx", "name", "feature", "level")
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    assert as_set(prep.onehot_fit(rows, ["a", "b", "c"]), "idx", "name", "feature", "level") == small
    assert sorted(i for i, *_ in small) == list(range(96 + 4))
    wide = prep.onehot_transform(rows, prep.onehot_fit(rows, ["a"]), [], ["row_key"])
    assert len(prep.feature_columns(wide)) == 96


def test_scaling_is_population_and_safe_for_constants(spark):
    df = spark.createDataFrame([(v, 5.0) for v in (1.0, 2.0, 4.0, 9.0)], "f_0 double, f_1 double")
    stats = prep.scale_fit(df, ["f_0", "f_1"])
    assert stats["f_0"] == pytest.approx((4.0, np.std([1, 2, 4, 9]))) and stats["f_1"] == (5.0, 1.0)
    z = prep.scale_transform(df, stats).agg(F.avg("f_0"), F.stddev_pop("f_0"), F.max("f_1")).first()
    assert tuple(z) == pytest.approx((0.0, 1.0, 0.0))


@pytest.mark.parametrize("exact", [False, True])
def test_split_is_stratified_and_ignores_partitioning(spark, exact):
    df = spark.range(5000).selectExpr("id AS row_key", "CAST(id % 4 = 0 AS INT) AS y")
    first = as_set(prep.stratified_split(df, "y", "row_key", exact=exact), "row_key", "split")
    for n in (1, 7):
        assert as_set(prep.stratified_split(df.repartition(n), "y", "row_key", exact=exact), "row_key", "split") == first
    tests = [k for k, s in first if s == "test"]
    ones, zeros = sum(k % 4 == 0 for k in tests), sum(k % 4 != 0 for k in tests)
    if exact:
        assert (ones, zeros) == (250, 750)
    else:
        assert ones / 1250 == pytest.approx(0.2, abs=0.05) and zeros / 3750 == pytest.approx(0.2, abs=0.03)


@pytest.mark.parametrize("n_rows,n", [(10, 3), (9, 3), (5, 5), (7, 1)])
def test_chunks_and_remainder(spark, n_rows, n):
    df = spark.range(n_rows).selectExpr("id AS row_key", "CAST(id % 2 AS INT) AS y")
    sizes = dict(as_set(prep.assign_clients(df, n, "row_key").groupBy("client_id").count(), "client_id", "count"))
    chunk = n_rows // n
    assert sizes == {i: chunk if i < n - 1 else n_rows - chunk * (n - 1) for i in range(n)}


@pytest.mark.parametrize("strategy,flag", [("non-iid", False), ("NonIID", False), ("label_skew", False), ("iid", True)])
def test_label_skew_orders_by_label(spark, strategy, flag):
    df = spark.range(100).selectExpr("id AS row_key", "CAST(id % 2 AS INT) AS y")
    got = prep.assign_clients(df, 4, "row_key", strategy, label_skew=flag)
    assert as_set(got, "client_id", "y") == {(0, 0), (1, 0), (2, 1), (3, 1)}


def test_label_skew_with_very_many_labels(spark, monkeypatch):
    df = spark.range(500).selectExpr("id AS row_key", "CAST(id % 120 AS INT) AS y")
    few = as_set(prep.assign_clients(df, 7, "row_key", "non-iid"), "row_key", "client_id")
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 10)
    assert as_set(prep.assign_clients(df, 7, "row_key", "non-iid"), "row_key", "client_id") == few


def test_client_count_is_checked(spark):
    df = spark.range(3).selectExpr("id AS row_key", "0 AS y")
    with pytest.raises(ValueError, match="into 0 clients"):
        prep.assign_clients(df, 0, "row_key")
    with pytest.raises(ValueError, match="4 clients need"):
        prep.assign_clients(df, 4, "row_key")


def test_load_failure_is_one_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="cannot load samples") as e:
        read_samples(spark, str(tmp_path / "absent"))
    assert e.value.__cause__ is not None
    spark.createDataFrame([(1, "a,b")], "k int, t string").write.option("header", True).csv(str(tmp_path / "t"))
    assert as_set(read_samples(spark, str(tmp_path / "t"), "k int, t string", "csv", header=True), "k", "t") == {(1, "a,b")}


def test_model_store_replaces_a_round(spark):
    path = new_path(spark, "store")
    for r in (0, 1):
        write_model(init_model(spark, 3, r), path)
    write_model(init_model(spark, 3, 1).withColumn("value", F.lit(2.5)), path)
    assert as_set(read_model(spark, path), "round", "value") == {(0, 0.0), (1, 2.5)}
    assert read_model(spark, path, 1).count() == 4


def test_metrics_documents(spark):
    path = new_path(spark, "documents")
    rows = [("a", r, 0.5 + r / 10, 1.0 * r, 0.1, 0.2, 0.3, 1024 * r) for r in (2, 1, 3)]
    fields = "run string, round int, accuracy double, total_time double, training_time double, encryption_time double, aggregation_time double, communication_size_bytes bigint"
    metrics = spark.createDataFrame(rows, fields)
    write_metrics(metrics, path, {"num_clients": "3"})
    assert as_set(read_metrics(spark, path), *metrics.columns) == set(rows)
    doc = spark.read.json(path).first()
    assert doc.config.num_clients == "3" and [r["round"] for r in doc.rounds] == [1, 2, 3]
    assert doc.summary.final_accuracy == 0.8 and doc.timestamp[4] == "-"
