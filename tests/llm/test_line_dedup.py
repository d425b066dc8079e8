import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import line_dedup as ld


def brute(rows, min_lines=ld.MIN_LINES, long_line=ld.LONG_LINE):
    """Texts after deleting every line of every later copy, by trying all windows; rows in order."""
    lines = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for t in rows]
    first, gone = {}, [set() for _ in rows]
    for d, doc in enumerate(lines):
        for j in range(len(doc)):
            for n in range(1, len(doc) - j + 1):
                window = tuple(x for _, x in doc[j : j + n])
                if first.setdefault(window, (d, j)) != (d, j) and (n >= min_lines or n == 1 and len(window[0]) >= long_line):
                    gone[d].update(i for i, _ in doc[j : j + n])
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(rows)]


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_random_texts_against_all_windows(spark, min_lines):
    rng = random.Random(min_lines)
    pool = [f"l{i}" for i in range(6)] + [f"a long line that counts alone {i}" for i in range(3)] + ["", "   "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += [texts[3], texts[3] + "\n" + texts[4], "x\n" * 20, None, "", "a\nb\na\nb\na\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    df = df.withColumns({c: F.lit(1) for c in ("u", "j", "id", "line", "first", "rank", "gone", "filled")})
    order = df.collect()
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(order, df.schema), min_lines=min_lines).collect()}
    want = brute([t for _, t in sorted((r.doc_id, r.text or "") for r in order)], min_lines)
    assert [got[i] or "" for i in range(len(texts))] == want and got[texts.index(None)] is None


def test_odd_rows(spark, odd_documents):
    out = ld.dedup_lines(odd_documents)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert len(rows) == odd_documents.count() and sum(r.doc_id == 3 and r.text == "" for r in rows) == 1
    assert {r.text for r in rows if r.doc_id == 7} == {"  \n\n \t "} and [r.text for r in rows if r.doc_id == 1] == [None]
    assert ld.dedup_lines(odd_documents.limit(0)).count() == 0


def test_a_repeat_is_measured_and_needs_no_python(spark):
    block = "\n".join(f"n{i}" for i in range(11))
    df = spark.createDataFrame([(1, block), (2, "x\n" + block + "\ny"), (3, "z")], "doc_id long, text string")
    out = ld.dedup_lines(df, report=True)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.longest_repeat, r.text) for r in out.collect()}
    assert got == {1: (11, 0, 0, block), 2: (13, 11, 8, "x\ny"), 3: (1, 0, 0, "z")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        ld.dedup_lines(df, min_lines=3)
