import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_dartminhash import brute as classes
from test_decontaminate import brute as leaks
from test_line_dedup import brute as cut_lines
from test_packing import check_batches
from veilframe.llm import dartminhash, decontaminate, line_dedup, packing, quality

SF = "/root/testdata/sf0.001"


def test_columns_with_the_names_of_helpers_stay(spark):
    rows = [(1, "a b c d e f g h i j k\nthe second line of it is long", "x"), (2, "a b c d e f g h i j k\nthe second line of it is long", "y"), (3, "quite another text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("_u", "_gone", "_longest", "spans", "_spans", "_quality_score")})
    items = spark.createDataFrame([(1, "quite another")], "item_id long, text string")
    kept = [line_dedup.dedup_lines(docs), dartminhash.drop_near_duplicates(docs), decontaminate.remove_leaks(docs, items), decontaminate.remove_leaks(docs, items, max_share=0.9)]
    assert [df.columns == docs.columns and {(r._u, r._gone, r._longest, r.spans, r._spans) for r in df.collect()} == {(7, 7, 7, 7, 7)} for df in kept] == [True] * 4
    assert [df.count() for df in kept] == [3, 2, 2, 3]
    assert cp.line_stage(spark, docs, SF).columns == docs.columns


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into every stage and what comes out, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        out.append((docs, rows))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_stages_keep_the_columns(steps):
    for (docs, rows) in steps[:-1]:
        assert rows[0].__fields__ == docs.columns


def test_each_stage_against_brute_force(spark, steps):
    (raw, good), (before_cut, cut), (before_near, unique), (before_leaks, clean), (before_pack, packed) = steps
    model = quality.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good} == {r.doc_id for r in raw.collect() if model.score(quality.term_counts(r.text)[None])[0] >= 0.5}
    rows = sorted(before_cut.collect(), key=lambda r: r.doc_id)
    want = dict(zip((r.doc_id for r in rows), cut_lines([r.text for r in rows])))
    assert {r.doc_id: (r.text, r.n_chars) for r in cut} == {d: (t, len(t)) for d, t in want.items()}
    groups = classes([(r.doc_id, r.text) for r in before_near.collect()])
    assert sorted(r.doc_id for r in unique) == sorted({c for _, c in groups})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0]: r[4] for r in leaks([(r.doc_id, r.text) for r in before_leaks.collect()], items, 10)}
    assert sorted(r.doc_id for r in clean) == sorted(d for d, h in hit.items() if not h)
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in clean)
    check_batches(packed, packing.BUDGET)


def test_odd_documents_pass_through_every_stage(spark, odd_documents):
    rng = random.Random(1)
    more = spark.createDataFrame([(100 + i, " ".join(f"w{rng.random()}" for _ in range(50)), "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_documents.select(*more.columns).unionByName(more)
    for docs in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            after = stage(spark, docs, SF)
            docs = spark.createDataFrame(after.collect(), after.schema)
        assert docs.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"]
