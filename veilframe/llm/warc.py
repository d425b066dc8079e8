"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

A file is a skippable frame (magic 0x184D2A5D) holding the dictionary, then one Zstandard frame per record, so any reader
that knows the convention opens it and any record can be read alone from its offset. The dictionary is trained, in one task, on a
written and bounded sample of the records that are archived: a block of ``DICTIONARY_BYTES`` of each of about ``DICTIONARY_PAGES`` pages, from
an offset that a hash draws, so that every part of a page has its share in it.

Records with equal payloads are stored once: the one with the largest page id is the response, the others are revisit
records that carry the HTTP head and point to it by its record id. Payloads shorter than ``min_revisit_bytes`` are always stored.

Groups of equal payloads are found by SHA-1 and length over narrow rows, aggregated before the shuffle; a group of any size
meets its response in a join that adaptive execution may split. Each task writes files of its own; only those in the written
manifest count. Rows are told apart by their place in the input, so ``pages`` must be a table scan (or another frame
that yields the same partitions each time it is read).

Defined cases: null html is an empty payload; a null url leaves the target out; null page ids are smaller than any other;
of rows that repeat page id and payload one is the response; no pages give no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import hash_draw
from veilframe.storage import materialize, new_path

DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
DICTIONARY_PAGES, DICTIONARY_BYTES, DICTIONARY_SIZE = 800, 8192, 1 << 16
FILE_BYTES = 1 << 30
LEVEL = 3
CRLF = b"\r\n"
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str, own_id: str | None = None, refers_id: str | None = None) -> bytes:
    """Bytes of one record; a revisit holds the HTTP head of the full payload but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(own_id) if own_id else uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=URI)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_id is not None:
            lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.UUID(refers_id)}>")
        if refers_to is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + CRLF + CRLF


#: Characters of an URI that stay as they are; ``quote`` escapes the others, line ends among them.
URI = "%:/?#[]@!$&'()*+,;=~"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_SIZE) -> bytes:
    """A dictionary of the samples, empty where they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _train(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    samples = []
    for batch in batches:
        for body, url, size, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
            samples.append(record(len(samples), url, body, size, base64.b32encode(bytes.fromhex(sha1)).decode(), None, False, date))
    yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(samples)], pa.binary())], ["dictionary"])


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
    part, out, rows, size, done = TaskContext.get().partitionId(), None, 0, 0, []
    for batch in batches:
        for page_id, url, payload, length, sha1, revisit, refers_to, own_id, refers_id in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None or size >= file_bytes:
                if out is not None:
                    out.close()
                    done.append((uri, rows, size))
                uri, rows, size = f"{folder}/pages-{part:06d}-{uuid.uuid4().hex}.warc.zst", 0, 0
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                if dictionary:
                    out.write(DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            frame = press.compress(record(page_id, url, payload or b"", length, digest, refers_to, revisit, date, own_id, refers_id))
            out.write(frame)
            rows, size = rows + 1, size + len(frame)
    if out is not None:
        out.close()
        done.append((uri, rows, size))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "records", "bytes"])


def write_warc(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive every page; the manifest (archive, records, bytes), written."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "sha1": F.sha1("body")})
    # each row is drawn by its hash with the same chance, so about DICTIONARY_PAGES rows are drawn at any size
    chance = min(1.0, DICTIONARY_PAGES / max(1, pages.count()))
    drawn = rows.where(hash_draw(chance, "k", "uid"))
    offset = F.pmod(F.xxhash64("uid", "k"), F.greatest(F.col("size") - DICTIONARY_BYTES, F.lit(0)) + 1).cast("int")
    sample = materialize(drawn.select(F.substring("body", offset + 1, F.lit(DICTIONARY_BYTES)).alias("body"), "url", "size", "sha1"), "dictionary-sample")
    found = sample.coalesce(1).mapInArrow(lambda it: _train(it, date), "dictionary binary").first()
    dictionary = bytes(found.dictionary) if found else b""
    groups = rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha1", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("k", "uid")).alias("kept")).where("n > 1")
    marked = rows.join(groups.select("sha1", "size", "kept"), ["sha1", "size"], "left")
    revisit = F.coalesce(F.col("uid") != F.col("kept.uid"), F.lit(False))
    own_id, refers_id = (F.md5(F.concat_ws(":", "sha1", "size", u)) for u in ("uid", "kept.uid"))
    records = marked.select("k", "url", F.when(~revisit, F.col("body")).alias("body"), "size", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("kept.k")).alias("refers_to"), own_id.alias("own_id"), F.when(revisit, refers_id).alias("refers_id"))
    written = records.mapInArrow(lambda it: _write(it, folder, dictionary, date, file_bytes), "archive string, records long, bytes long")
    return materialize(written, "warc-manifest")


def open_archive(uri: str) -> io.BufferedReader:
    """The archive's records as one stream of bytes, with the dictionary of its first frame."""
    fs, path = filesystem(uri)
    file = io.BufferedReader(fs.open_input_stream(path, compression=None, buffer_size=1 << 20))
    data = None
    if file.peek(4)[:4] == DICTIONARY_FRAME:
        file.read(4)
        data = zstandard.ZstdCompressionDict(file.read(int.from_bytes(file.read(4), "little")))
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=data).stream_reader(file, read_across_frames=True), 1 << 18)


def records_of(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC fields, HTTP head, payload) of every record."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != CRLF + CRLF or len(block) != int(fields["Content-Length"]):
            raise ValueError("a record is cut off")
        head, _, payload = block.partition(CRLF + CRLF)
        yield fields, head, payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, rows = [c.split()[0] for c in COLUMNS.split(", ")], []

    def flush():
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for fields, head, payload in records_of(open_archive(uri)):
                size = int(head.rpartition(b"Content-Length: ")[2])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"a payload in {uri} differs from its digest")
                page_id, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                rows.append((int(page_id) if page_id else None, size, digest, kind, int(refers) if refers else None, fields.get("WARC-Target-URI"), uri))
                if len(rows) >= 5000:
                    yield flush()
                    rows.clear()
    yield flush()


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest (of the full payload), record_type,
    refers_to, url, archive. A payload that differs from its digest raises."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(n).mapInArrow(_read, COLUMNS)
