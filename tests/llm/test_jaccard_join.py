import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import jaccard_join as jj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=90):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    ids = lambda r: [rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None]
    return sorted(((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else min(ids(root[i]), default=None)) for i in range(len(rows))), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in jj.linked(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for size, copies, edits in ((60, 70, 2), (120, 40, 4), (30, 30, 1), (8, 20, 1), (400, 12, 15), (3, 20, 1)):
        base = rng.choices(words, k=size)
        for _ in range(copies):  # near copies around the limit, in long chains
            new = list(base)
            for _ in range(rng.randrange(edits + 1)):
                new[rng.randrange(size)] = rng.choice([f"x{rng.random()}", rng.choice(words)])
            rows.append(" ".join(new[rng.randrange(2) :]))
    common = " ".join(f"boiler{i}" for i in range(50))  # a passage that many hold
    rows += [common + " " + " ".join(rng.choices(words, k=rng.choice([1, 3, 40]))) for _ in range(40)]
    rows += ["a b", "A  B", "a b c", "a", "", None, " \t\n\x0b\x0c\r ", "a\x1cb", "ünï cödé 日本 x", "word " * 20_000, "Ünï cödé 日本 x"] * 2
    rng.shuffle(rows)
    return [(None if i % 97 == 5 else i % 400, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block, percent", [(1024, 90), (6, 90), (10, 75)])
def test_random_documents(spark, rows, monkeypatch, block, percent):
    monkeypatch.setattr(jj, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("u", "id", "t", "n", "g", "print", "bucket", "root", "place", "class")})
    assert got(df, percent=percent) == brute([tuple(r) for r in df.select("doc_id", "text").collect()], percent)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(empty) == []
    assert got(spark.createDataFrame([(4, None), (5, "x y z a")], empty.schema)) == [(4, 0, 4), (5, 2, 5)]


def test_a_forest_connects_what_is_near():
    rng = np.random.default_rng(3)
    for _ in range(50):
        near = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.25

        def parts(edges):
            root = list(range(sum(near.shape)))
            for a, b in edges:
                x, y = root[a], root[near.shape[0] + b]
                root = [x if r == y else r for r in root]
            return [[r == s for s in root] for r in root]

        forest = list(jj._forest(near))
        assert parts(forest) == parts(zip(*np.nonzero(near))) and all(near[a, b] for a, b in forest) and len(forest) < sum(near.shape)


def test_prefixes_are_long_enough():
    for percent in (50, 90):
        for n in range(1, 60):
            for m in range(n, 60):
                least = next((c for c in range(n + 1) if 100 * c >= percent * (n + m - c)), None)
                if least is not None:  # a set with so many shingles in common cannot keep all of them out of its prefix
                    assert n - least < jj.prefix_size(n, percent) and m - least < jj.prefix_size(m, percent)


def test_rows_meet_only_classes_with_other_roots(spark):
    rows = [(1, 5, 10), (1, 5, 10), (1, 6, 10), (1, 7, 11), (1, 20, 12), (2, 3, 1), (2, 5, 2), (3, 4, 1), (3, 4, 2)]
    df = spark.createDataFrame([(b, c, r, i) for i, (b, c, r) in enumerate(rows)], "bucket long, class long, root long, u long")
    got = {r.u: sorted(r.classes) for r in jj.with_other_roots(df).collect()}
    want = {}
    for i, (b, c, r) in enumerate(rows):
        if near := sorted({d for a, d, s in rows if a == b and abs(c - d) <= 1 and s != r}):
            want[i] = near
    assert got == want == {2: [7], 3: [6], 7: [4], 8: [4]}
