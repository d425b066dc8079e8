import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.functions import paillier
from veilframe.functions.paillier import Decryptor, Encryptor, PublicKey, generate_keypair, packing
from veilframe.operators import combine as cb
from veilframe.operators import encrypted as enc
from veilframe.storage import materialize

UPDATE = "round int, client_id string, param string, idx int, value double, num_samples bigint"
ELEMENT = ["round", "param", "idx"]
KEY = generate_keypair(512, seed=11)


def vectors(spark, *clients):
    rows = [(1, f"c{k}", "W", i, float(v), n) for k, (values, n) in enumerate(clients) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, UPDATE)


def values(df):
    return [r.value for r in sorted(df.collect(), key=lambda r: r.idx)]


def test_weighted_mean(spark):
    df = vectors(spark, ([1, 2, 3], 1), ([9, 10, 11], 3))
    assert values(cb.fedavg(df)) == [7, 8, 9]
    assert values(cb.fedavg(vectors(spark, ([1.0], 0)))) == [None]


@pytest.mark.parametrize("clients,want", [([4], 4), ([4, 1], 2.5), ([9, 1, 4], 4), ([9, 1, 4, 100], 6.5)])
def test_median_of_few(spark, clients, want):
    assert values(cb.median_update(vectors(spark, *[([c], 1) for c in clients]))) == [want]


def test_median_ignores_weights_and_useless_updates(spark):
    df = vectors(spark, ([1], 1000), ([2], 1), ([3], 1), ([50], 0), ([60], -5), ([float("nan")], 1))
    assert values(cb.median_update(df)) == [2]


@pytest.mark.parametrize("case", ["spread", "ties", "two values", "even halves", "infinite", "sorted"])
def test_median_of_large_groups_is_exact(spark, case):
    rng = np.random.default_rng(5)
    n = 20_001 if case != "sorted" else 20_000
    data = {
        "spread": rng.normal(size=n),
        "ties": np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n)),
        "two values": np.where(np.arange(n) < n // 2, 1.0, 2.0),
        "even halves": np.where(np.arange(n - 1) < n // 2, 1.0, 2.0),
        "infinite": np.where(np.arange(n) < n // 3, -np.inf, np.where(np.arange(n) % 2 == 0, np.inf, np.arange(n) * 1e-3)),
        "sorted": np.arange(n, dtype=float),
    }[case]
    rows = [(1, "c", "W", 0, float(v), 1) for v in data] + [(1, "c", "W", 1, float(v), 1) for v in data[:10]]
    df = spark.createDataFrame(rows, UPDATE).repartition(6)
    got = values(cb.median_update(df, max_group_rows=1000))
    assert got == [np.median(data), np.median(data[:10])]


def test_median_of_one_very_large_group_moves_sketches_only(spark):
    rows = spark.range(10_000_000).selectExpr("1 AS round", "'W' AS param", "0 AS idx", "CAST(hash(id) AS DOUBLE) AS value", "1 AS num_samples")
    got = values(cb.median_update(rows, max_group_rows=20_000))
    assert got == [rows.selectExpr("percentile(value, 0.5D)").first()[0]]


def test_sketched_medians_keep_their_rank_and_merge(spark):
    rows = spark.range(60_000).selectExpr("1 AS round", "'W' AS param", "CAST(id % 2 AS INT) AS idx", "CAST(id AS DOUBLE) AS value", "1 AS num_samples", "concat('c', id) AS client_id")
    parts = [cb.median_sketch(rows.where(F.col("value") % 3 == i)) for i in range(3)]
    merged = cb.sketch_median(cb.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()
    for r in [*merged, *cb.sketch_median(cb.median_sketch(rows)).collect()]:
        assert r.n == 30_000 and abs(r.value - 30_000) < 60_000 * 0.017


def test_empty_round_and_missing_elements_keep_the_model(spark):
    previous = spark.createDataFrame([(1, "W", 0, 5.0), (1, "W", 1, 6.0)], "round int, param string, idx int, value double")
    for how in ("fedavg", "median"):
        assert values(cb.combine(vectors(spark, ([1, 2], 0)), previous, how)) == [5, 6]
        assert values(cb.combine(vectors(spark, ([1], 2)), previous, how)) == [1, 6]
    with pytest.raises(ValueError):
        cb.combine(vectors(spark, ([1], 1)), previous, "mean")


def test_reshape(spark):
    rows = [(1, p, i, float(i)) for p, n in (("W", 6), ("b", 2)) for i in range(n)]
    model = spark.createDataFrame(rows, "round int, param string, idx int, value double")
    matrix = cb.to_rows(model, {"W": (2, 3), "b": (2,)})
    assert {(r.param, r.row): r.x for r in matrix.collect()} == {("W", 0): [0, 1, 2], ("W", 1): [3, 4, 5], ("b", 0): [0, 1]}
    assert as_set(cb.to_elements(matrix), "round", "param", "idx", "value") == set(rows)


# ---- encrypted ----


def test_public_key_travels_as_text():
    wire = json.loads(json.dumps(KEY.public.to_wire()))
    assert PublicKey.from_wire(wire) == KEY.public and set(wire) == {"n"}
    with pytest.raises(TypeError):
        PublicKey.from_wire("123")


@pytest.mark.parametrize("bits", [256, 384])
def test_numbers_add_and_scale(bits):
    key = generate_keypair(bits)
    assert key.public.n.bit_length() == bits
    e, d, square = Encryptor(key.public), Decryptor(key), key.public.n**2
    for a, b in [(1.5, -2.25), (0.1, 0.2), (-1e-9, 1e6), (0.0, 0.0)]:
        assert d.value(e.encrypt(a)) == a
        assert d.value(e.encrypt(a) * e.encrypt(b) % square) == pytest.approx(a + b, abs=1e-12)
        assert d.value(pow(e.encrypt(a), 7, square)) == pytest.approx(7 * a, abs=1e-12)
    assert e.encrypt(1.0) != e.encrypt(1.0)


def test_overflow_is_raised_not_wrapped():
    e, d, n = Encryptor(KEY.public), Decryptor(KEY), KEY.public.n
    with pytest.raises(OverflowError):
        e.encrypt(float(n >> (paillier.SCALE_BITS + 1)))
    almost = e.encrypt(float(n // 4 >> paillier.SCALE_BITS))
    with pytest.raises(OverflowError):
        d.decrypt(pow(almost, 2, n * n))


def test_encrypted_sum_and_mean(spark):
    df = vectors(spark, ([1, 2, 3], 1), ([10, 20, 30], 1))
    sent = enc.he_encrypt(df, "value", KEY.public)
    total = enc.he_decrypt(enc.he_weighted_sum(sent, ELEMENT, KEY.public), "cipher", KEY)
    assert values(total) == [11, 22, 33]
    df = vectors(spark, ([1, 2, 3], 1), ([9, 10, 11], 3))
    assert values(enc.he_fedavg(enc.he_encrypt(df, "value", KEY.public), ELEMENT, KEY)) == [7, 8, 9]


def test_encrypted_mean_equals_plain_mean_when_one_group_is_hot(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(1, f"c{i}", "W", 0 if i % 3 else int(rng.integers(40)), float(rng.normal()), int(rng.integers(1, 9))) for i in range(1500)]
    df = spark.createDataFrame(rows, UPDATE).repartition(5)
    monkeypatch.setattr(enc, "OUT_ROWS", 3)
    got = enc.he_fedavg(enc.he_encrypt(df, "value", KEY.public, tasks=4), ELEMENT, KEY)
    want = {r.idx: r.value for r in cb.fedavg(df).collect()}
    assert {r.idx: r.value for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_encrypted_edge_cases(spark):
    none = enc.he_fedavg(enc.he_encrypt(vectors(spark, ([1.0], 1)).where("idx > 5"), "value", KEY.public), ELEMENT, KEY)
    assert none.collect() == []
    zero = enc.he_fedavg(enc.he_encrypt(vectors(spark, ([1.0], 0)), "value", KEY.public), ELEMENT, KEY)
    assert values(zero) == [None]


def test_wire_form(spark):
    sent = enc.he_encrypt(vectors(spark, ([-0.5], 1)), "value", KEY.public).select("idx", enc.to_wire("cipher").alias("t"))
    text = json.loads(sent.first().t)
    assert set(text) == {"ciphertext", "exponent"} and text["ciphertext"].isdigit()
    fixed = spark.createDataFrame([(0, json.dumps(text))], "idx int, t string")
    back = enc.he_decrypt(fixed.select("idx", enc.from_wire("t").alias("cipher")), "cipher", KEY)
    assert values(back) == [-0.5]
    other = json.dumps({**text, "exponent": -3})
    bad = spark.createDataFrame([(0, other)], "idx int, t string").select(enc.from_wire("t").alias("cipher"))
    with pytest.raises(Exception, match="unexpected exponent"):
        enc.he_decrypt(bad, "cipher", KEY).collect()


def test_long_vectors_encrypt(spark):
    """Vectors of ten and more elements, client side, with only the public key."""
    df = vectors(spark, (range(25), 2))
    sent = enc.he_encrypt(df, "value", PublicKey.from_wire(KEY.public.to_wire()), tasks=3)
    assert values(enc.he_decrypt(sent, "cipher", KEY)) == list(range(25))
    assert sent.select(F.countDistinct("cipher.ciphertext")).first()[0] == 25


def test_packed_updates_average_like_plain_ones(spark):
    rng, key = np.random.default_rng(4), generate_keypair(512, seed=3)
    rows = [(1, f"c{c}", p, i, float(v), c * 3) for c in range(6) for p in "AB" for i, v in enumerate(rng.normal(size=11) * 10.0 ** rng.integers(-6, 3))]
    rows = [r if (r[1], r[3]) != ("c2", 7) else (*r[:4], None, r[5]) for r in rows] + [(1, "c1", "C", 4, float("nan"), 3), (1, "c3", "C", 5, -2.5, 9)]
    df = spark.createDataFrame(rows, UPDATE)
    plan = enc.plan_packing(df, key.public, ["round", "param", "idx"], weight="num_samples")
    assert plan.slots >= 4
    sent = materialize(enc.he_encrypt_packed(df, ["round", "client_id", "param"], key.public, plan, weight="num_samples"), "packed")
    assert sent.count() <= 6 * 2 * 3 + 1
    got = {(r.param, r.idx): r.value for r in enc.he_fedavg_packed(sent, ["round", "param"], key, plan).collect()}
    want = {(r.param, r.idx): r.value for r in cb.fedavg(cb.collect_updates(df), ["round", "param", "idx"]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-10) for k, v in want.items())


def test_slots_hold_signs_and_sums_up_to_their_bound():
    key = generate_keypair(512, seed=3)
    plan = packing(key.public, 7.5, 1000)
    values = {i: (-1) ** i * 7.5 for i in range(plan.slots)}
    sums = plan.unpack(sum([plan.pack(values)] * 1000))
    assert [s / (1 << plan.bits) for s in sums] == [1000 * values[i] for i in range(plan.slots)]
    with pytest.raises(OverflowError):
        plan.pack({0: 7.6})
    with pytest.raises(OverflowError):
        packing(key.public, 1.0, 1 << 600)
    assert packing(PublicKey((1 << 2048) - 1), 100.0, 10**9).slots >= 10  # at least ten times fewer encryptions at 2,048 bits
