import zlib

import numpy as np
import pytest

from veilframe.llm import quality as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    scored = q.score(docs.select("doc_id", "text"), q.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [(r.score >= 0.5) == (r.quality == 1) for r in held]
    assert len(held) > 60 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_held_out_rows_are_never_learned_from(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = q.train(docs, labels), q.train(docs, flipped)
    assert a.mean == b.mean and sorted(a.labels.tolist()) == sorted(b.labels.tolist()) and np.allclose(np.abs(a.idf), np.abs(b.idf))


def test_scores_equal_a_plain_loop(spark, tables):
    docs, labels = tables
    model = q.train(docs, labels)
    some = docs.limit(20).collect()
    got = {r.doc_id: r.score for r in q.score(spark.createDataFrame(some, docs.schema), model).collect()}
    for r in some:
        z = model.project(q.term_counts(r.text)[None])[0].astype(float)
        cos = sorted(((float(z @ v), y) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)[: q.NEIGHBOURS]
        weights = [max(c, 0) ** q.SHARPNESS for c, _ in cos]
        assert got[r.doc_id] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, cos)) / sum(weights), abs=1e-3)


def test_odd_rows(spark, tables, odd_documents):
    docs, labels = tables
    strange = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 1, 0), (5, 1, 0)], labels.schema))
    model = q.train(docs, strange)
    scored = q.score(odd_documents.drop("score"), model).collect()
    assert len(scored) == odd_documents.count()
    assert all(r.score == pytest.approx(model.mean) for r in scored if not r.text)
    kept = q.keep_good(odd_documents, model)
    assert kept.columns == odd_documents.columns
    empty = q.train(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, empty).collect()} == {0.5}
    assert q.score(docs.limit(0), model).count() == 0 and q.train(docs.limit(0), labels).mean == 0.5


def test_the_sample_is_bounded(spark, tables):
    docs, labels = tables
    many = docs.crossJoin(spark.range(30)).drop("id")
    assert len(q.train(many, labels, most=300).labels) < 450


def test_chunks_count_every_triple():
    text = "äbc " * 50
    whole = q.term_counts(text)
    kept, q.CHUNK = q.CHUNK, 7
    try:
        assert np.array_equal(q.term_counts(text), whole) and whole[:-1].sum() == len(text.encode()) - 2
    finally:
        q.CHUNK = kept


def test_broadcast_needs_no_installed_package(spark, tables):
    import pickle
    import subprocess
    import sys

    docs, labels = tables
    m = q.train(docs, labels)
    data = pickle.dumps((m.idf, m.directions, m.vectors, m.labels, m.mean))
    code = "import pickle, sys; pickle.load(sys.stdin.buffer); assert not any(x.startswith('veilframe') for x in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], input=data, cwd="/tmp").returncode == 0
