"""Token-id shards: raw id payloads with a minimal perfect hash index for keyed access.

Documents are dealt out by ranges of their key, so shard after shard holds them in ascending key order. Each task writes
one file:

    magic | raw ids | starts of the documents in the payload | keys in file order | index | JSON header | its length

Ids take two bytes while the vocabulary fits, else four. The index is a minimal perfect hash over the shard's distinct
keys: levels of bit arrays, each holding the keys that fell on a bit alone, with the rank of a key's bit as its slot. A
slot stores a 64-bit fingerprint (a bijection of the key, so a foreign key is never taken for a stored one) and the number
of the key's first document. A lookup reads one bit per level and one slot, whatever the shard's size.

Files get a name of their own per task attempt; only those named in the written manifest count, so lost or repeated tasks
leave nothing behind that is read. Tasks hold the index of one shard and a batch of texts, never the payload.

Defined cases: null and empty texts are documents of only the end id; null keys come first and are read back but cannot be
looked up; repeated keys stay separate documents that a lookup returns together, in file order (their order among
themselves is the written one); no documents give no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.memory import release
from veilframe.storage import materialize, new_path

MAGIC = b"VFTOKEN1"
MANIFEST = "part int, file string, docs long, tokens long, first_key long, last_key long"
#: Text whose distinct words are looked at together.
BLOCK_BYTES = 1 << 22
#: Letters that lower-case one to one, then ASCII marks: two pieces that are encoded apart in any text.
SIMPLE = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Words of all these letters, in lower case.
LETTERS = " ".join("".join(map(chr, x)) for a in range(97, 123) for x in ((a, *(c for c in range(0xDF, 0x100) if c != 0xF7)), (a, 110), (116, 104, a)))
#: Four control characters part words in Arrow but not for the tokenizer.
CONTROLS = "[\x1c-\x1f]"
#: Ids read at a time when shards are read back.
IDS_AT_ONCE = 1 << 21


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``chosen`` of a ragged array one after the other, and their sizes."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[chosen] - (ends - n), n) + np.arange(total)], n


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    Texts are split and their words told apart in Arrow arrays; every distinct word of a block of texts is cut into letters, which
    are lower-cased, and ASCII marks, and only distinct ones of these go to the library. Nothing is kept from block to block.
    ``word_end`` marks the vocabulary's last pieces of words. The ids are those the library gives for the whole text.
    """

    def __init__(self, path: str, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core; threads would each keep a heap
        from tokenizers import Tokenizer
        from tokenizers import pre_tokenizers as cuts

        self.library = Tokenizer.from_file(path)
        # stems are lower-case letters already: where the tokenizer looks at bytes of words, its model is all they need
        self.stems = Tokenizer(self.library.model)
        self.stems.pre_tokenizer = cuts.Sequence([cuts.WhitespaceSplit(), cuts.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.stems.encode(LETTERS, add_special_tokens=False).ids != self.library.encode(LETTERS, add_special_tokens=False).ids:
            self.stems = self.library
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(word_end)]] = True

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of every text, by the library."""
        ids = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each`` for lower-case letters, a thousand words at a time as one text."""
        groups = [pieces[at : at + 1000] for at in range(0, len(pieces), 1000)]
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self.stems.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            one = (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(group) else self._each(group)
            flat.append(one[0])
            sizes.append(one[1])
        return np.concatenate(flat), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of distinct words."""
        cut = pc.extract_regex(words, SIMPLE)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(cut.field("stem").filter(pa.array(simple))).dictionary_encode()
        marks = cut.field("marks").filter(pa.array(simple)).dictionary_encode()
        odd = words.filter(pa.array(~simple)).to_pylist()
        parts = [self._pieces(stems.dictionary.to_pylist()), self._each(marks.dictionary.to_pylist()), self._each(odd), (np.zeros(0, self.dtype), np.zeros(1, np.int64))]
        flat, sizes = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        starts = np.cumsum(sizes) - sizes
        pair = np.empty((len(words), 2), np.int64)
        n_stems, n_marks = len(stems.dictionary), len(marks.dictionary)
        pair[simple, 0], pair[simple, 1] = stems.indices.to_numpy(), marks.indices.to_numpy() + n_stems
        pair[~simple, 0], pair[~simple, 1] = np.arange(len(odd)) + n_stems + n_marks, len(sizes) - 1
        ids, n = _gather(flat, starts, sizes, pair.reshape(-1))
        return ids, n.reshape(-1, 2).sum(axis=1)

    def _block(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        split = pc.utf8_split_whitespace(texts)
        first = split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        flat, sizes = self._words(words.dictionary)
        codes = words.indices.to_numpy()
        out, n = _gather(flat, np.cumsum(sizes) - sizes, sizes, codes) if ids else (None, sizes[codes])
        before = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(before[split.offsets.to_numpy() - first])

    def blocks(self, texts: pa.Array, ids: bool = True) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """(ids one after the other, their number per text) for ever so many texts of about ``BLOCK_BYTES``, none of them null."""
        odd = pc.match_substring_regex(texts, CONTROLS).to_numpy(zero_copy_only=False)
        long = pc.binary_length(texts).to_numpy() > BLOCK_BYTES
        size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            if odd[at]:
                out, n = self._each([texts[at].as_py()])
                at += 1
                yield out, n
                continue
            if long[at]:  # a text of its own, cut at white space
                parts = [self._block(pa.array([x]), ids) for x in _cut(texts[at].as_py())]
                at += 1
                yield np.concatenate([x for x, _ in parts]) if ids else None, np.array([sum(int(n[0]) for _, n in parts)])
                continue
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right"))
            end = at + next((i for i in range(1, end - at) if odd[at + i] or long[at + i]), max(1, end - at))
            yield self._block(texts.slice(at, end - at), ids)
            at = end


def _cut(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES // 4
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: key -> slot in 0..n-1; any other key -> some slot or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(words) else np.zeros(0, np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
            return (mix(keys.view(np.uint64) + seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys.astype(np.int64)
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64)
        out, left, offset = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = self._place(keys[left], level, size) + offset
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            found = (word >> shift) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << shift) - np.uint64(1))
            out[left[found]] = (self.before[bit >> 6] + np.bitwise_count(below))[found]
            left, offset = left[~found], offset + size
        return out


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardReader:
    """One shard: its index in memory, its payload read where it is asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        header_size = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.header = h = json.loads(self.file.read_at(header_size, size - 8 - header_size))
        self.dtype = np.dtype(h["dtype"])
        self.starts, self.keys, self.nulls = self._part("starts", "<i8"), self._part("keys", "<i8"), h["nulls"]
        self.hash = PerfectHash(h["levels"], self._part("bits", "<u8"))
        self.prints, self.firsts = self._part("prints", "<u8"), self._part("firsts", "<i8")

    def _part(self, name: str, dtype: str) -> np.ndarray:
        at, n = self.header[name]
        return np.frombuffer(self.file.read_at(n, at), dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document, -1 where the shard has none."""
        slots = self.hash.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == mix(keys[ok].astype(np.int64).view(np.uint64))
        return np.where(ok, self.firsts[np.where(ok, slots, 0)], -1) if len(self.firsts) else slots

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents first..last-1, as one array."""
        a, b, w = int(self.starts[first]), int(self.starts[last]), self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, len(MAGIC) + a * w), self.dtype)

    def runs(self, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in ``keys``, document) of every document of every key."""
        for i, first in enumerate(self.find(keys).tolist()):
            while first >= self.nulls and first < len(self.keys) and self.keys[first] == keys[i]:
                yield i, first
                first += 1

    def close(self) -> None:
        self.file.close()


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, part = WordEncoder(tokenizer), TaskContext.get().partitionId()
    uri = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.bin"
    out, keys, sizes, nulls = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            fs, path = filesystem(uri)
            fs.create_dir(folder if "://" not in folder else filesystem(folder)[1], recursive=True)
            out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
            out.write(MAGIC)
        for ids, n in enc.blocks(batch.column(1)):
            out.write(np.insert(ids, np.cumsum(n), end_id).tobytes())
            sizes.append(n + 1)
        nulls += batch.column(0).null_count
        keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
    if out is None:
        return
    keys, sizes = np.concatenate(keys), np.concatenate(sizes)
    distinct, firsts = np.unique(keys[nulls:], return_index=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, first_of = np.empty(len(distinct), "<u8"), np.empty(len(distinct), "<i8")
    prints[slots], first_of[slots] = mix(distinct.view(np.uint64)), firsts + nulls
    starts = np.concatenate([[0], np.cumsum(sizes)])
    header, at = {"dtype": enc.dtype.str, "nulls": nulls, "levels": index.sizes, "end_id": end_id}, len(MAGIC) + int(starts[-1]) * enc.dtype.itemsize
    for name, array, kind in (("starts", starts, "<i8"), ("keys", keys, "<i8"), ("bits", index.words, "<u8"), ("prints", prints, "<u8"), ("firsts", first_of, "<i8")):
        data = array.astype(kind).tobytes()
        out.write(data)
        header[name] = [at, len(data)]
        at += len(data)
    text = json.dumps(header).encode()
    out.write(text + len(text).to_bytes(8, "little"))
    out.close()
    some = len(distinct) > 0
    row = {"part": [part], "file": [uri], "docs": [len(keys)], "tokens": [int(starts[-1])], "first_key": [int(distinct[0]) if some else None], "last_key": [int(distinct[-1]) if some else None]}
    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))
    del enc
    release()


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of every text into shards; the manifest, one row per shard with the ids before it (``start``).

    ``tokenizer`` is a path every executor has. ``shards`` defaults to the shuffle partitions; choose it so that a shard
    is some hundred MB. A key held by very many rows is split over shards by a random second key.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange(n, "k", "salt").sortWithinPartitions("k").select("k", "t")
    written = materialize(ranged.mapInArrow(lambda it: _write_shard(it, folder, tokenizer, end_id), MANIFEST), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_shard(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = ShardReader(uri)
            n, cuts = len(shard.keys), shard.starts
            distinct, firsts = np.unique(shard.keys[shard.nulls :], return_index=True)
            if not np.array_equal(shard.find(distinct), firsts + shard.nulls):
                raise ValueError(f"the index of {uri} does not lead to its documents")
            first = 0
            while first < n:
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + IDS_AT_ONCE, "right")) - 1)
                last = min(last, n, first + 50_000)
                wide = shard.ids(first, last).astype("<u4")
                view, bounds = memoryview(wide.tobytes()), ((cuts[first : last + 1] - cuts[first]) * 4).tolist()
                crc = [zlib.crc32(view[a:b]) for a, b in zip(bounds, bounds[1:])]
                gone = np.arange(first, last) < shard.nulls
                columns = [pa.array(shard.keys[first:last], pa.int64(), mask=gone), pa.array(cuts[first:last] + start, pa.int64()), pa.array(np.diff(cuts[first : last + 1]), pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts[first : last + 1] - cuts[first], pa.int32()), pa.array(wide.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)
                first = last
            shard.close()


def read_token_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32, and ids if asked for.

    Every key is looked up in its shard's index on the way; a shard that fails this raises.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = manifest.select("file", "start")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(lambda it: _read_shard(it, with_ids), schema)


def _fetch(batches: Iterator[pa.RecordBatch], files: list[str], first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        # shards whose key range meets the batch's; ranges ascend and meet at their ends only
        for at in range(int(np.searchsorted(last, keys.min(), "left")), int(np.searchsorted(first, keys.max(), "right"))):
            wanted, shard = keys[(keys >= first[at]) & (keys <= last[at])], ShardReader(files[at])
            rows = [(int(wanted[i]), shard.ids(d, d + 1).astype(np.int64)) for i, d in shard.runs(wanted)]
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])


def fetch_documents(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and ids of every document whose key is in ``keys``, through the index; absent and null keys give no row.

    Keys are dealt out by ranges like the shards, so a task opens few of them. The driver holds one row per shard.
    """
    rows = manifest.where("first_key IS NOT NULL").orderBy("part").select("file", "first_key", "last_key").collect()
    files, first, last = [r.file for r in rows], np.array([r.first_key for r in rows], np.int64), np.array([r.last_key for r in rows], np.int64)
    wanted = keys.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    return wanted.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(lambda it: _fetch(it, files, first, last), "doc_id long, ids array<long>")


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    enc = WordEncoder(tokenizer)
    for batch in batches:
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in enc.blocks(batch.column(1), ids=False))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
    del enc
    release()


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens (without an end id) of every row; null and empty texts have none."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(lambda it: _count(it, tokenizer), schema)
