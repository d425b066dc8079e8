import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest

import corpus_pipeline as cp
from veilframe.llm import packing as pk
from veilframe.llm import queries


def padded(histogram, ends):
    return sum(c * (next(e for e in ends if e >= l) - l) for l, c in histogram)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        histogram = [(l, rng.randrange(1, 50)) for l in rng.sample(range(0, 40), rng.randrange(1, 9))]
        lengths = sorted(l for l, _ in histogram)
        for k in (1, 2, 3, 5):
            got = pk.boundaries(histogram, k)
            assert len(got) <= k and got[-1] == lengths[-1]
            best = min(padded(histogram, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
            assert padded(histogram, got) == best
    assert pk.boundaries([]) == []


def check_batches(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) * rs[0].bucket_len <= budget or len(rs) == 1
        if (bucket, batch + 1) in batches:  # only a bucket's last batch has room left
            assert (len(rs) + 1) * rs[0].bucket_len > budget


@pytest.mark.parametrize("slice_rows", [7, pk.SLICE])
def test_every_document_is_packed_once(spark, documents, odd_documents, slice_rows):
    docs = documents.unionByName(odd_documents.select(*documents.columns)).selectExpr("*", "1 u", "2 bucket", "3 slice", "4 n", "5 l", "6 nr")
    rows = pk.pack(docs, buckets=5, budget=3000, slice_rows=slice_rows).collect()
    want = Counter((r.doc_id, len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    check_batches(rows, 3000)
    ends = pk.boundaries(list(Counter(r.n_tokens if r.n_tokens <= pk.EXACT else r.bucket_len for r in rows).items()), 5)
    assert {r.bucket_len for r in rows} <= set(ends)


def test_no_documents_and_long_ones(spark, documents):
    assert pk.pack(documents.limit(0)).count() == 0
    df = spark.createDataFrame([(i, n) for i, n in enumerate([8192, 8193, 100_000, 100_001, 1 << 40, 0, None])], "doc_id long, tokens long")
    rows = pk.pack(df, length=df.tokens, text="doc_id", buckets=50, budget=10).collect()
    check_batches(rows, 10)
    assert all(r.padding <= r.n_tokens / 256 + 1 for r in rows) and len(rows) == 7


def test_boundaries_of_long_documents_are_optimal(spark):
    rng = random.Random(2)
    tokens = [rng.choice([20_020, 20_021, 9_001, 9_003, 8_195, 100_001, 40, 7]) for _ in range(60)] + [100_003]
    df = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, tokens long")
    histogram = list(Counter(tokens).items())
    lengths = sorted(set(tokens))
    for k in (1, 3, 5):
        rows = pk.pack(df, length=df.tokens, text="doc_id", buckets=k).collect()
        best = min(padded(histogram, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))
        assert sum(r.padding for r in rows) == best and {r.bucket_len for r in rows} <= set(lengths)


def test_query_and_pipeline_stage_measure_tokens(spark, documents, odd_documents, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = spark.createDataFrame([(900, "日本語の文章を分けずに書く" * 500), (901, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 300)], "doc_id long, text string")
    docs = documents.limit(50).select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text")).unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for packed in (queries.op10_packing(spark, str(tmp_path)), cp.packing_stage(spark, docs, str(tmp_path))):
        rows = packed.collect()
        assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
        check_batches(rows, pk.BUDGET)
