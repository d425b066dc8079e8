import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import dartminhash as dm
from veilframe.llm.components import components

SF = "/root/testdata/sf0.01"


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b, weighted):
    if not weighted:
        union = len(a.keys() | b.keys())
        return len(a.keys() & b.keys()) / union if union else 1.0
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute(rows, weighted=False, least=0.8):
    """Sorted (doc_id, class_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if weighted or small >= least * large or not large:
                if similarity(sets[i], sets[j], weighted) >= least:
                    parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append((d is None, d or 0, d))
    return sorted(((d, min(ids[find(i)])[2]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.class_id) for r in rows), key=str), sum(r.kept for r in rows)


def near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(words // 30)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_against_all_pairs(spark, documents, odd_documents, weighted, monkeypatch):
    monkeypatch.setattr(dm, "BLOCK", 16)  # buckets of several blocks
    copies = [(10_000 + i, t) for i, t in enumerate(near_copies(60, 1) + near_copies(40, 2, 40))]
    docs = documents.select("doc_id", "text").unionByName(odd_documents.select(F.col("doc_id") + 50_000, "text").toDF("doc_id", "text")).unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit(1) for c in ("u", "print", "n", "bands", "band", "value", "first", "top", "set")})
    want = brute([(r.doc_id, r.text) for r in docs.collect()], weighted)
    assert len({c for _, c in want}) < len(want) - 60
    got, kept = found(dm.near_duplicates(docs, weighted=weighted))
    assert got == want and kept == len({c for _, c in want})
    if not weighted:
        left = dm.drop_near_duplicates(docs)
        assert left.columns == docs.columns and left.count() == kept


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, kept = found(dm.near_duplicates(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()]) and kept < len(got)


def test_no_documents(spark, documents):
    assert dm.near_duplicates(documents.limit(0)).count() == 0


def test_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    wa, wb = rng.uniform(0, 4, 60), rng.uniform(0, 4, 60)
    wa[:10] = 0
    keep = wa > 0
    sig = dm.dart_signatures(np.concatenate([x[keep], x]), np.concatenate([wa[keep], wb]), np.array([keep.sum(), 60]), k=4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 3, 700, 5000, 20)]
    together = dm.dart_signatures(np.concatenate(sets), None, np.array([len(s) for s in sets]))
    alone = [dm.dart_signatures(s, None, np.array([len(s)]))[0] for s in sets]
    assert np.array_equal(together, np.stack(alone)) and not (together == dm._EMPTY).any()
    ones = dm.dart_signatures(np.concatenate(sets), np.ones(sum(map(len, sets))), np.array([len(s) for s in sets]))
    assert np.array_equal(together, ones)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3), (7000, 6999), (6999, 7000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 7000: 6999, 6999: 6999}
