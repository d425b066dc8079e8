import base64
import hashlib
import io

import zstandard

from veilframe.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    """(page_id, html) -> multiset of what the archives must say."""
    body = [((-1 if p is None else p), p, (h or "").encode()) for p, h in rows]
    kept, out, used = {}, [], set()
    for order, p, b in body:
        kept[b] = max(kept.get(b, (-2, None)), (order, p), key=lambda x: x[0])
    for order, p, b in body:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        response = kept[b][0] == order and b not in used
        if response:
            used.add(b)
        out.append((p, len(b), digest, "response" if response else "revisit", None if response else kept[b][1]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    back = warc.read_warc(warc.write_warc(pages))
    assert got(back) == expected(rows)
    urls = {r.page_id: r.url for r in pages.collect()}
    assert all(r.url == urls[r.page_id] for r in back.collect())


def test_odd_pages(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (2, "v", "a"), (None, "n", "a"), (None, None, "b"), (None, None, "b"), (5, "x\r\ny: z", None), (6, "", ""), (7, "ü", "é" * 300_000), (8, "w", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 size", "2 sha1", "3 uid", "4 kept", "5 body", "6 n", "7 k")
    assert got(warc.read_warc(warc.write_warc(pages))) == expected([(p, h) for p, _, h in rows])
    assert got(warc.read_warc(warc.write_warc(pages.limit(0)))) == []


def test_small_payloads_are_always_stored_when_asked(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, min_revisit_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_files_lead_with_the_dictionary_and_hold_a_frame_per_record(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    row = warc.write_warc(pages, file_bytes=20_000).orderBy("archive").first()
    fs, path = warc.filesystem(row.archive)
    data = fs.open_input_file(path).read()
    assert data[:4] == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    press, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size, 0
    while at < len(data):
        one = press.decompressobj()
        text = one.decompress(data[at:])
        assert text.startswith(b"WARC/1.1") and sum(1 for _ in warc.records_of(io.BufferedReader(io.BytesIO(text)))) == 1
        at, n = len(data) - len(one.unused_data), n + 1
    assert n == row.records > 1


def test_revisits_name_their_response_and_samples_come_from_everywhere(spark, monkeypatch):
    tails = [(i, "u", f"{i} " + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(40_000)) + "the very same closing words of every page " * 30) for i in range(40)]
    pages = spark.createDataFrame(tails + [(99, "u", tails[0][2])], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "DICTIONARY_BYTES", 1024)
    files = [r.archive for r in warc.write_warc(pages).collect()]
    fields = [f for uri in files for f, _, _ in warc.records_of(warc.open_archive(uri))]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(ids) == 41 and [ids[f["WARC-Refers-To"]]["Page-ID"] for f in revisits] == ["99"]
    fs, path = warc.filesystem(files[0])
    data = fs.open_input_file(path).read()
    assert b"closing words" in data[8 : 8 + int.from_bytes(data[4:8], "little")]
