import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import secrets as sc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    letters = sc.learn_letters(spark.read.parquet(f"{SF}/documents.parquet"))
    findings = sc.labelled_findings(spark).withColumn("held", F.pmod(F.xxhash64("value"), F.lit(4)) == 0)
    return letters, sc.train(findings.where("not held"), letters), findings.where("held")


def test_held_out_findings(learned):
    letters, model, held = learned
    rows = sc.judge(held, letters, model).collect()
    right = sum((r.probability >= 0.5) == (r.secret == 1) for r in rows)
    assert len(rows) > 500 and right / len(rows) >= 0.97


def test_the_tables_tokens_are_found_and_nothing_else(spark, learned):
    letters, model, _ = learned
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, m.lower()) for r in docs.collect() for m in re.findall(r'token = "([0-9a-f]{40})', r.text, re.I))
    got = sorted((r.doc_id, r.value.lower()) for r in sc.find_secrets(docs, letters, model).collect())
    assert len(want) > 5 and got == want


def test_features_equal_a_plain_loop(spark, learned):
    letters = learned[0]
    counts = {r.piece: r.n for r in sc.corpus_letters(spark.createDataFrame([("the then, THE x-y",)], "text string")).collect()}
    assert counts == {"_t": 3, "th": 3, "he": 3, "e_": 2, "en": 1, "n_": 1, "the": 3, "hen": 1, "_x": 1, "x_": 1, "_y": 1, "y_": 1}
    rows = [("abcdEFGH12345678", 'token =', '"abcdEFGH12345678",', "tests/a"), ("thethethethethethe", None, "thethethethethethe", None)]
    got = sc.with_features(spark.createDataFrame(rows, "value string, before string, word string, path string"), letters).collect()
    a, b = got
    assert (a["size"], a.digits, a.capitals, a.assigned, a.quoted, a.credential, a.testing) == (16, 0.5, 0.25, 1, 1, 1, 1)
    assert b.coverage > 0.9 and b.transitions > a.transitions and (b.assigned, b.quoted, b.testing) == (0, 0, 0)


def test_odd_rows(spark, learned, odd_documents):
    letters, model, _ = learned
    docs = odd_documents.withColumns({c: F.lit(1) for c in ("value", "before", "word", "path", "features", "nr", "probability")})
    assert sc.find_secrets(docs, letters, model).count() == 0
    assert sc.find_secrets(docs.limit(0), letters, model).count() == 0
    extra = spark.createDataFrame([(1, "x" * 5000 + ' token = "0123456789abcdef0123456789abcdef01234567"', None)], "doc_id long, text string, source string")
    assert [r.value[:4] for r in sc.find_secrets(extra, letters, model).collect()] == ["0123"]
    empty = sc.learn_letters(docs.limit(0))
    assert sc.find_secrets(extra, empty, model).count() >= 0
    plan = sc.find_secrets(docs, letters, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_values_after_credential_words_are_candidates(spark):
    texts = ['set password = "hunter2!x", then', "pwd: Tr0ub4dor&3", "the secret=ab.cd#ef$12 and more", '{"api_key": "k3y@mail.x"}', "a password is required: yes", "he said: nothing = here", "token = short", 'token = "0123456789abcdef0123456789abcdef01234567"', "password:", "password = "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("src0"))
    got = {(r.doc_id, r.value) for r in sc.candidates(docs).collect()}
    assert got == {(0, "hunter2!x"), (1, "Tr0ub4dor&3"), (2, "ab.cd#ef$12"), (3, "k3y@mail.x"), (7, "0123456789abcdef0123456789abcdef01234567")}


def plain_candidates(text):
    """Candidates by a plain loop over the words."""
    words, out = re.split(r"[ \t\r\n]+", text), []
    for i, w in enumerate(words):
        runs = re.findall(sc.CANDIDATE, w)
        before = " ".join(words[j] for j in (i - 2, i - 1) if j >= 0)
        head = re.match(r"[^=:]*[=:]+", w)
        value = re.match(sc.VALUE, w)
        if not runs and sc.SHORT <= len(w) < 256 and value and re.search(sc.ASSIGNED, before + " " + (head[0] if head else "")):
            runs = [value[1]]
        out += [(i, r) for r in runs]
    return out


def test_candidates_equal_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", "source").collect()
    extra = [(-1, 'password = "hunter2!x" pwd: Tr0ub4dor&3, my token=abc.def! x', "s"), (-2, "secret => 'a,b;c.d' api_key:z9z9z9", None)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + extra, "doc_id long, text string, source string")
    want = sorted((d, *x) for d, t, _ in docs.collect() for x in plain_candidates(t))
    assert sorted((r.doc_id, r.nr, r.value) for r in sc.candidates(docs).collect()) == want and len(want) > 50


def test_short_secrets_are_judged_and_addresses_and_paths_help(spark, learned):
    letters, model, _ = learned
    texts = ['password = "hunter2!x9"', "pwd: Tr0ub4dor&3", 'password = "changeme"', "password: required", "token = undefined", 'secret = "********"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("src0"))
    found = {r.doc_id for r in sc.find_secrets(docs, letters, model).collect()}
    assert found == {0, 1}
    rows = [("abcdefghijklmnopqrst", None, w, None) for w in ("foo.com/abcdefghijklmnopqrst", "a.py:abcdefghijklmnopqrst", "abcdefghijklmnopqrst.", "x@y.abcdefghijklmnopqrst")]
    got = sc.with_features(spark.createDataFrame(rows, "value string, before string, word string, path string"), letters).collect()
    assert [r.address for r in got] == [1, 1, 0, 1]
