import re

import pytest

from veilframe.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size):
    """[(doc_id, n_words, hit places, items)] by sliding every window over every document."""
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[x]
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [dc.BROADCAST_WINDOWS, 0])
def test_against_brute_force(spark, documents, odd_documents, limit):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(900, "four five SIX"), (901, "Word"), (902, None), (903, " ... "), (None, "One two three"), (900, "spaces"), (904, "the of")]
    bench = bench.unionByName(spark.createDataFrame(extra, bench.schema)).selectExpr("*", "1 as hash", "2 as len", "3 as win")
    docs = documents.unionByName(odd_documents.select(*documents.columns)).selectExpr("*", "1 as u", "2 as s", "3 as h", "4 as w")
    rows, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]
    want = brute(rows, items, 10)
    assert sum(r[4] for r in want) > 5
    assert found(dc.find_leaks(docs, bench, broadcast_windows=limit)) == want
    kept = dc.remove_leaks(docs, bench, broadcast_windows=limit)
    assert kept.columns == docs.columns and kept.count() == sum(not r[4] for r in want)


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d, e! And that."), (2, "a B c"), (3, None), (4, "none"), (5, "a b c x a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d"), (2, "c d e")], "item_id long, text string")
    kept = {r.doc_id: r.text for r in dc.remove_leaks(docs, bench, size=3, max_share=0.9).collect()}
    assert kept == {1: "Keep this. \nAnd that.", 3: None, 4: "none", 5: "\nx \n"}


def test_nothing_to_compare(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.find_leaks(documents.limit(0), bench).count() == 0
    none = dc.find_leaks(documents, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == documents.count()


def test_plan_has_no_python_and_does_not_shuffle_texts(spark, documents):
    plan = dc.find_leaks(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert all("text" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
