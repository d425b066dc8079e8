import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import source_audit as sa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        docs[lang or ""].update(set(words(text)))
        counts[lang or "", source or ""].update(words(text))
    kept = {lang: sorted((t for t, n in c.items() if n >= 3), key=str.encode) for lang, c in docs.items()}

    def share(parts, lang):
        n = Counter()
        for c in parts:
            n.update({t: c[t] for t in kept[lang] if c[t]})
        total = sum(n.values()) + len(kept[lang])
        return n, [1 + 10**9 * (n[t] + 1) // total for t in kept[lang]]

    out = []
    for lang, source in counts:
        n, p = share([counts[lang, source]], lang)
        _, q = share([c for (x, _), c in counts.items() if x == lang], lang)
        others = {s: share([counts[x, s]], lang)[1] for x, s in counts if x == lang and s != source}
        pair = [(sum((a - b) ** 2 // b for a, b in zip(p, o)), s) for s, o in others.items()]
        term = [((a - b) ** 2 // b, t) for t, a, b in zip(kept[lang], p, q) if n[t] and a > b]
        for part, found, most in (("pair", pair, None), ("term", term, 200)):
            order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in sa.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = [a + b for a in ("Wort", "ö", "the", "日本", "z") for b in ("", "A", "b", "ung", "ungen", "é")]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 30))), rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 4)}") for i in range(90)]
    rows += [(1, "the the\x00THE-the9the", None, None), (1, None, None, None), (2, "a b\x7fc", "xx", "q"), (2, "", "xx", "p"), (None, "日本 the", "en", "s9")]
    return rows + [(7, "long " * 30_000 + "ö퟿€" * 5000, "en", "s1")] * 3


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_random_documents(spark, rows, monkeypatch, broadcast_bytes):
    for name, value in (("SLICE_TERMS", 5), ("HELD", 20), ("PAIRS", 30), ("CHUNK", 100), ("BLOCK_BYTES", 1000), ("CELLS", 16), ("SOURCES_AT_ONCE", 2)):
        monkeypatch.setattr(sa, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("term", "n", "p", "q", "value", "slice", "part", "blob")})
    assert got(df, broadcast_bytes=broadcast_bytes) == brute(rows)


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    rare = [(1, "x", "en", "a"), (2, None, "en", "b")]
    assert got(spark.createDataFrame(rare, SCHEMA)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_transducer_numbers_terms_in_byte_order():
    rng = random.Random(5)
    found = sorted({bytes(rng.choices(b"abc\xc3\xff", k=rng.randrange(1, 7))) for _ in range(2000)} | {b"q" * 300})
    t = sa.Transducer.load(sa.Transducer.build(found).dump())
    other = [b"", b"abca" * 9, b"\xff" * 8, b"zz"]
    assert t.numbers(found + other).tolist() == [*range(len(found)), -1, -1, -1, -1]
    assert [t.term(i) for i in range(len(found))] == found
    assert len(t.final) < sum(map(len, found)) / 4
    assert sa.Transducer.build([]).numbers([b"a"]).tolist() == [-1]
