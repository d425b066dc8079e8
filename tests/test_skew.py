import random

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.operators.index import global_index, hash_assign, hash_counts, hash_index, row_hash
from veilframe.skew import attach, hot_keys, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i * 3 + 1, "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.choice([None, rng.randrange(50)])) for i in range(3000)]
    return data, spark.createDataFrame(data, "seq bigint, k string, v bigint").repartition(5).cache()


def expected(data, how, inclusive):
    out, state = {}, {}
    for seq, k, v in sorted(data):
        seen = state.setdefault(k, [])
        used = seen + [v] if inclusive else list(seen)
        present = [x for x in used if x is not None]
        if how == "count":
            out[seq] = len(present)
        else:
            out[seq] = None if not present else (max if how == "max" else sum)(present)
        seen.append(v)
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 40, 7])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_a_sequential_loop(rows, hot_rows, inclusive):
    data, df = rows
    outputs = {how: (how, F.col("v")) for how in ("max", "sum", "count")}
    got = running(df, ["k"], "seq", outputs, inclusive, hot_rows=hot_rows).collect()
    assert len(got) == len(data)
    for how in outputs:
        assert {r.seq: r[how] for r in got} == expected(data, how, inclusive)


def test_hot_keys_stay_few(rows):
    data, df = rows
    hot = hot_keys(df, ["k"], hot_rows=5, max_keys=3)
    assert hot.count() <= 3 and "hot" in {r.k for r in hot.collect()}
    assert hot_keys(df, ["k"], hot_rows=10**6) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_rows,hot_rows", [(0, 10), (5, 10), (0, 10**6), (1000, 10)])
def test_attach_is_a_join_whatever_the_sizes(spark, rows, how, max_rows, hot_rows):
    data, df = rows
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "k string, w int")
    got = attach(df, side, ["k"], how, max_rows=max_rows, hot_rows=hot_rows)
    want = df.join(side, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_global_index(rows, partitions):
    data, df = rows
    got = global_index(df.select("k", "seq"), ["k", "seq"], partitions).collect()
    ordered = sorted((k, seq) for seq, k, _ in data)
    assert [(r.k, r.seq) for r in sorted(got, key=lambda r: r.position)] == ordered
    assert sorted(r.position for r in got) == list(range(len(data)))


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_hash_index_ignores_partitioning(spark, rows, partitions):
    data, df = rows
    got = hash_index(df.select("k", "seq").repartition(partitions), "seq", 5, by=["k"], digits=2)
    plain = df.select("k", "seq", row_hash(5, "seq").alias("h")).collect()
    want = set()
    for k in {r.k for r in plain}:
        for i, r in enumerate(sorted((r for r in plain if r.k == k), key=lambda r: r.h)):
            want.add((k, r.seq, i))
    assert as_set(got, "k", "seq", "position") == want


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("chunk", [1, 37, 2999, 5000])
def test_hash_assign_cuts_the_hash_order(rows, digits, chunk):
    data, df = rows
    df = df.select("seq", (F.col("seq") % 2).alias("y"))
    counts = hash_counts(df, 42, "seq", lead=["y"], digits=digits)
    got = hash_assign(df, "seq", counts, lambda p: F.floor(p / F.lit(chunk)), "c", lead=["y"])
    order = df.select("seq", "y", row_hash(42, "seq").alias("h")).orderBy("y", "h").collect()
    assert as_set(got, "seq", "c") == {(r.seq, i // chunk) for i, r in enumerate(order)}
