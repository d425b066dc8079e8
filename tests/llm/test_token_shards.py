import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from veilframe.llm import token_shards as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    """(doc_id, text) in file order -> what reading back must give."""
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_reads_back_what_the_library_gives(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = ts.read_token_shards(ts.write_token_shards(documents, PATH, 1, shards=5)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_odd_rows_and_clashing_columns(spark, odd_documents):
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    manifest = ts.write_token_shards(odd_documents, PATH, 1, shards=3)
    got = ts.read_token_shards(manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    wanted = spark.createDataFrame([(3,), (6,), (99,), (None,), (1,), (3,)], "doc_id long")
    found = ts.fetch_documents(manifest, wanted).collect()
    lib = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    assert sorted(r.doc_id for r in found) == [1, 3, 3, 6]
    assert all(r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids + [1] for r in found)


def test_no_documents(spark, documents):
    manifest = ts.write_token_shards(documents.limit(0), PATH, 1)
    assert manifest.count() == 0 and ts.read_token_shards(manifest, with_ids=True).count() == 0


def test_index_is_minimal_and_refuses_foreign_keys(tmp_path):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    index = ts.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert len(index.words) * 64 < 5 * len(keys)
    assert len(ts.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def test_split_words_equal_whole_texts():
    enc = ts.WordEncoder(PATH)
    texts = ["a's b'll c'd x' 'y <|endoftext|> q<|endoftext|>z İstanbul ΑΣ ß Ÿÿ µm ét́", "x y z\x85w", "...!? a.b,c 12ab3", "naïve, naïve! NAÏVE"]
    want, n = enc._each(texts)
    got = list(enc.blocks(pa.array(texts)))
    assert np.concatenate([x for x, _ in got]).tolist() == want.tolist() and np.concatenate([x for _, x in got]).tolist() == n.tolist()


def test_ids_of_odd_texts_are_those_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    pool = list("aZé ÉßİıẞǺ̈'st1²٣ \t\n\x0b\x0c\r\x1c\x1f\x85\u00a0\u2028\u3000\u200b日本.,!-~[]`{}\x00\x7f") + ["'s", "<|endoftext|>", "</w>", "ÀÖ", "word"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(3000)] + ["", " ", "long words " * 300]
    encoder = ts.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for size in (1 << 24, 60):
        monkeypatch.setattr(ts, "BLOCK_BYTES", size)
        got = [x.tolist() for ids, n in encoder.blocks(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want
        assert [x for _, n in encoder.blocks(pa.array(texts), ids=False) for x in n] == [len(x) for x in want]
