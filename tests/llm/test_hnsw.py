import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import hnsw

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    """{query_id: [(vec_id, cosine)]} by comparing all; equal cosines in the order of ids."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i not in queries:
            continue
        same = [(j, np.array(w, float)) for j, w in good if j != i and len(w) == len(v)]
        q, best = np.array(v, float), {}
        for j, w in same:
            best[j] = max(best.get(j, -2), float(hnsw.cosine(q, w)))
        out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_over_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = found(hnsw.search(hnsw.build_index(table, 5, shard_vectors=300), table.where("vec_id % 50 = 0"), 5))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95
    exact = {(q, i): s for q, r in brute(rows, set(want), len(rows)).items() for i, s in r}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, r in got.items() for i, s in r)
    assert all(r == sorted(r, key=lambda x: (-x[1], x[0])) for r in got.values())


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, []), (105, [1.0, float("inf"), 0.0])]
    rows += [(None, [1.0, 2.0, 0.5]), (50, [-1.0, -2.0, -0.5]), (51, [1.0, 0.0]), (52, [2.0, 0.1]), (7, [1.0, 2.0, 0.5]), (70, [3.0, 1.0, 0.0]), (60, [1e-30, 2e-30, 0.0]), (61, [1e200, 2e200, 3e199])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 id", "2 vec", "3 dim", "4 shard", "5 nr")
    want = brute(rows, {i for i, _ in rows}, 5)
    got = found(hnsw.search(hnsw.build_index(df, 5, shard_vectors=4), df, 5))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_no_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = hnsw.build_index(table.limit(0), 5)
    assert index.count() == 0 and hnsw.search(index, table, 5).count() == 0
    assert hnsw.search(hnsw.build_index(table, 5), table.limit(0), 5).count() == 0


def test_levels_shrink_and_neighbours_are_bounded():
    x = np.random.default_rng(2).normal(size=(1500, 16))
    graph = hnsw.Graph.build(hnsw.unit(x))
    assert graph.counts[0] == 1500 and graph.counts == sorted(graph.counts, reverse=True)
    assert all(len(l) == c and l.shape[1] <= 2 * hnsw.M for l, c in zip(graph.links, graph.counts))
    nodes, score = graph.beam(hnsw.unit(x), 64)
    assert np.mean(nodes[np.arange(1500), score.argmax(1)] == np.arange(1500)) > 0.99


def test_groups_of_near_copies_are_ranked_exactly(spark):
    rng = np.random.default_rng(5)
    rows = [(1000 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 16)))]
    for size, first in ((40, 0), (250, 400)):  # within the beam, and beyond it
        base = rng.normal(size=16)
        rows += [(int(i), (base * (1 + rng.random()) * (1 + (j % 2) * 1e-8 * rng.normal(size=16))).tolist()) for j, i in enumerate(first + rng.permutation(size))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {*range(0, 40, 5), *range(400, 650, 25), *range(1000, 1300, 30)}
    want = brute(rows, asked, 5)
    got = found(hnsw.search(hnsw.build_index(df, 5), df.where(df.vec_id.isin(*asked)), 5))
    close = [q for q in asked if q < 1000]
    assert {q: got[q] for q in close} == {q: want[q] for q in close}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked]) >= 0.95 * 5


def test_an_id_of_many_vectors_takes_one_place(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    near = lambda noise: (base + noise * rng.normal(size=8)).tolist()
    rows = [(1, base.tolist())] + [(1, near(1e-3)) for _ in range(150)] + [(2, near(1e-2)) for _ in range(150)] + [(i, near(0.1)) for i in range(3, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(hnsw.search(hnsw.build_index(df, 5), spark.createDataFrame(rows[:1], df.schema), 5))
    best = {}
    for i, v in rows:
        best[i] = max(best.get(i, -2), float(hnsw.cosine(base, np.array(v))))
    assert got == {1: sorted(((i, s) for i, s in best.items() if i != 1), key=lambda x: (-x[1], x[0]))[:5]}


def test_queries_meet_shards_outside_the_driver(spark):
    rng = np.random.default_rng(7)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))] + [(1000 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, 5, shard_vectors=8)
    want = {q: [i for i, _ in r] for q, r in brute(rows, {i for i, _ in rows}, 5).items()}
    near = hnsw.search(index, df, 5, block=64)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan  # a join's planner takes queries times shards for the queries alone
    assert {q: [i for i, _ in r] for q, r in found(near).items()} == want
    several = hnsw.search(index, df, 5, block=16, held=900)  # groups of queries, one after the other
    assert {q: [i for i, _ in r] for q, r in found(several).items()} == want


def test_a_place_gets_its_shards_once_and_every_query(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(8).normal(size=(600, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, asked = hnsw.build_index(df, 5, shard_vectors=8), df.selectExpr("vec_id id", "embedding vec", "size(embedding) dim")
    places = hnsw.WAVES * spark.sparkContext.defaultParallelism
    assert index.count() > places
    for held, groups in ((2400, 1), (1200, 2)):
        laid = hnsw._laid(index, asked, 2400, 600, 100, held).withColumn("part", F.spark_partition_id())
        parts = laid.groupBy("part").agg(F.sum(F.size("queries")).alias("q"), F.count("vectors").alias("s"), F.count_distinct("held").alias("g")).collect()
        assert len(parts) == places * groups and all(r.g == 1 for r in parts)
        assert sum(r.q for r in parts) == places * 600 and sum(r.s for r in parts) == groups * index.count()
    one = hnsw._laid(hnsw.build_index(df, 5), asked, 2400, 600, 100, 2400).groupBy(F.spark_partition_id()).agg(F.sum(F.size("queries")).alias("q"), F.count("vectors").alias("s")).collect()
    assert len(one) == 6 and sum(r.q for r in one) == 600 and all(r.s == 1 for r in one)
