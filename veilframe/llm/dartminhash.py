"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set of word shingles. Darts fall on the plane of each element - weight along one side, rank along the
other - as a Poisson process of rate one that is a function of the element alone; every dart carries one of ``K`` coordinates. The
signature holds, per coordinate, the dart of least rank below the element's weight: two documents agree on a
coordinate with the probability of their weighted Jaccard similarity. Only ranks up to (K ln K + 2K) / total weight are thrown, which
fills every coordinate with high probability; a document that misses one throws again with twice the bound.

``BANDS`` bands of ``ROWS`` coordinates make buckets. With 32 x 5 a pair of similarity 0.8 misses all buckets once in 300,000.
The stages:

1. one pass over the texts: fingerprint of the shingle set and band values (written, about 300 bytes a document);
2. documents with equal fingerprints are copies: their smallest (doc_id, place) stands for them from here on;
3. buckets with several documents; of buckets with the same documents one is kept;
4. documents that buckets connect are compared exactly, all pairs of a connected group or, in very large groups, of a
   bucket. Groups are cut into blocks of about ``BLOCK`` members and ``BLOCK_BYTES`` of shingles, and every two blocks meet in a
   task's group of their own, so no task holds more than two blocks however large the group; a task returns a spanning
   forest of the links it found, never the pairs. Shingles are taken from the texts again, where up to ``BROADCAST_ROWS`` placements
   are broadcast and more are joined by shuffle;
5. connected components of the links are the classes.

Rows are told apart by their place in the input, so ``docs`` must be a table scan (or another frame that yields the same
partitions each time it is read).

Defined cases: words are those of ``text.words``; a text with fewer words than a shingle is one shingle; texts without words (null and
empty ones too) are copies of each other; repeated rows are copies; null doc_ids are larger than any other, and a class of only such rows has a
null class id; no documents give no rows; extra columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.llm.memory import release
from veilframe.llm.text import fresh
from veilframe.storage import materialize, materialize_counted

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
K = BANDS * ROWS
BLOCK, BLOCK_BYTES, TOGETHER, BROADCAST_ROWS = 256, 1 << 24, 8, 1_000_000
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A-Z to lower case, all other ASCII but letters and digits to blanks.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles in order of appearance."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, min(size, len(h))):
            out = out * _STEP + h[i : n + i]
    return mix(out)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """Signatures (documents x k, 64-bit) of documents given one after the other: distinct elements, weights, sizes.

    ``weights`` None stands for ones. The value of a coordinate is its dart's rank (float32 bits) over 32 bits of the dart's hash.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    if weights is None:
        seed, top, total = mix(elements), None, sizes.astype(float)
    else:
        columns = np.ceil(weights).astype(np.int64)  # columns of weight one; the last may be cut by the weight
        at = np.arange(columns.sum()) - np.repeat(np.cumsum(columns) - columns, columns)
        total = np.bincount(owner, weights, n)
        with np.errstate(over="ignore"):
            seed = mix(np.repeat(mix(elements), columns) + at.astype(np.uint64) * _TURN)
        top = np.repeat(weights, columns) - at  # darts above it miss
        seed, owner = np.where(at == 0, np.repeat(mix(elements), columns), seed), np.repeat(owner, columns)
    bound = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-12)
    out = np.full((n, k), _EMPTY)
    todo = total > 0
    while todo.any():
        out[todo] = _EMPTY
        flat = out.reshape(-1)
        live = np.flatnonzero(todo[owner])
        rank, drawn = np.zeros(len(live)), 0
        while len(live):
            g = int(np.clip((1 << 17) // len(live), 1, 64))
            with np.errstate(over="ignore"):
                h = mix(seed[live][:, None] + np.arange(drawn + 1, drawn + g + 1, dtype=np.uint64)[None] * _STEP)
                h2 = mix(h ^ _TURN)
            gaps = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            ranks = np.cumsum(np.concatenate([rank[:, None], gaps], axis=1), axis=1)[:, 1:]
            mine = owner[live]
            hit = ranks < bound[mine][:, None]
            if top is not None:
                hit &= (h2 & np.uint64(0xFFFF)).astype(np.float64) / 65536 < top[live][:, None]
            coordinate = (((h2 >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            place = (mine[:, None] * k + coordinate)[hit]
            value = (ranks[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h[hit] & np.uint64(0xFFFFFFFF))
            np.minimum.at(flat, place, value)
            stay = ranks[:, -1] < bound[mine]
            live, rank, drawn = live[stay], ranks[stay, -1], drawn + g
        todo = todo & (out == _EMPTY).any(axis=1)
        bound = np.where(todo, bound * 2, bound)
    return out


def band_values(signatures: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(signatures), BANDS), np.uint64)
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    for i in range(ROWS):
        acc = mix(acc ^ parts[:, :, i])
    return acc


def _sign(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts, at = batch.column(2).to_pylist(), 0
        while at < len(texts):
            sets, counts, prints, start, load = [], [], [], at, 0
            while at < len(texts) and load < 1 << 17:
                s, c = np.unique(shingles(texts[at]), return_counts=True)
                sets.append(s)
                counts.append(c)
                prints.append(xxh3_128_digest(s.tobytes() + (c.astype("<i8").tobytes() if weighted else b"")))
                load, at = load + len(s), at + 1
            sizes = np.array([len(s) for s in sets])
            weights = np.concatenate(counts).astype(float) if weighted else None
            bands = band_values(dart_signatures(np.concatenate(sets), weights, sizes)).view(np.int64)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, at - start), batch.column(1).slice(start, at - start), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))],
                ["u", "id", "print", "n", "bands"],
            )
    release()


def _sets(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    """(bucket, i, j, u, t) -> (bucket, i, j, u, set, counts); the rows of one text follow each other."""
    last, found = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part, rows = batch.slice(at, 128), []
            for u, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                if u != last:
                    s, c = np.unique(shingles(t), return_counts=True)
                    last, found = u, (s.tobytes(), c.astype("<u4").tobytes() if weighted else None)
                rows.append(found)
            columns = [pa.array(x, pa.binary()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], ["bucket", "i", "j", "u", "set", "counts"])
    release()


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def links_of(members: list[tuple[int, bytes, bytes | None]], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose (weighted) Jaccard similarity is ``least`` or more."""
    sets = [np.frombuffer(s, np.uint64) for _, s, _ in members]
    counts = [np.frombuffer(c, "<u4") if c is not None else None for _, _, c in members]
    n = len(sets)
    if n < 2:
        return []
    size = np.array([int(c.sum()) if c is not None else len(s) for s, c in zip(sets, counts)], np.float64)
    if counts[0] is not None:  # an element held c times is c elements, so the minimum of counts is an intersection
        with np.errstate(over="ignore"):
            sets = [np.repeat(s, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _TURN for s, c in zip(sets, counts)]
    all_, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    new = np.concatenate([[True], all_[1:] != all_[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((n, n))
    width = max(1, (1 << 22) // n)
    for at in range(0, int(shared.sum()), width):
        part = np.zeros((n, width), np.float32)
        lo, hi = np.searchsorted(column, [at, at + width])
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    # in whole numbers where they decide: common / union >= least
    near = common >= least * (size[:, None] + size[None] - common) - 1e-9
    parent = {i: i for i in range(n)}
    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = _find(parent, int(i)), _find(parent, int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((members[int(i)][0], members[int(j)][0]))
    return out


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j); each such group is two blocks of one bucket."""
    key, members, out = None, {}, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for k, u, s, c in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 6))):
            if k != key:
                out += links_of([(x, *y) for x, y in members.items()], least)
                key, members = k, {}
            members[u] = (s, c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
            out = []
    out = links_of([(x, *y) for x, y in members.items()], least)
    members.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _blocks(members, load):
    return F.greatest(F.ceil(members / BLOCK), F.ceil(load * 8 / BLOCK_BYTES)).cast("int")


def _members(in_bands: DataFrame) -> DataFrame:
    """(bucket, blocks, lead, u, n): members of buckets with several documents, one of the buckets with the same ones."""
    marks = [F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y")]
    groups = in_bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("load"), F.min("u").alias("lead"), *marks)
    kept = groups.where("m > 1").groupBy("m", "load", "lead", "x", "y").agg(F.min(F.struct("band", "value")).alias("at"))
    kept = kept.select("at.band", "at.value", "lead", _blocks(F.col("m"), F.col("load")).alias("blocks"))
    found = in_bands.join(kept, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "blocks", "lead", "u", "n")
    return materialize(found, "members")


def _placements(members: DataFrame) -> DataFrame:
    """(u, bucket, i, j): the pairs of blocks that a document is compared in.

    Documents that buckets connect are compared all together, so that each is sent once and not once per bucket. Where more
    than ``TOGETHER`` blocks are connected, which chance meetings can make of many groups, comparisons stay within buckets.
    """
    roots = components(members.select(F.col("lead").alias("a"), F.col("u").alias("b")))
    nodes = members.groupBy("u").agg(F.max("n").alias("n")).join(roots.withColumnRenamed("node", "u"), "u")
    sizes = nodes.groupBy("root").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("all_blocks"))
    rooted = materialize(nodes.join(sizes, "root"), "rooted")
    together = rooted.where(F.col("all_blocks") <= TOGETHER).select(F.col("root").alias("bucket"), F.col("all_blocks").alias("blocks"), "u")
    apart = members.join(rooted.where(F.col("all_blocks") > TOGETHER).select("u"), "u", "left_semi").select("bucket", "blocks", "u")
    both = together.unionByName(apart)
    own = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    every = both.select("bucket", "u", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return every.select("u", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _classes(docs: DataFrame, key: str, text: str, least: float, weighted: bool) -> DataFrame:
    """(u, id, class, kept): every row's class id and whether it is the row that stands for its class."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("id"), F.col(text).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = materialize(texts.mapInArrow(lambda it: _sign(it, weighted), f"u long, id {kind}, print binary, n long, bands array<long>"), "signatures")
    order = F.struct(F.col("id").isNull(), "id", "u")
    copies = signed.groupBy("print").agg(F.min(order).alias("first"), F.max("n").alias("n"), F.max_by("bands", "u").alias("bands"))
    texts_with = copies.where("n > 0").select(F.col("first.u").alias("u"), "n", F.posexplode("bands").alias("band", "value"))
    in_bands = materialize(texts_with, "bands")
    members = _members(in_bands)
    placed, rows = materialize_counted(_placements(members), "placements")
    side = F.broadcast(placed) if rows <= BROADCAST_ROWS else placed
    sets = texts.select("u", "t").join(side, "u").select("bucket", "i", "j", "u", "t").mapInArrow(lambda it: _sets(it, weighted), "bucket long, i int, j int, u long, set binary, counts binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = sets.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = laid.mapInArrow(lambda it: _compare(it, least), "a long, b long")
    roots = components(links)
    named = copies.select("print", "first", F.col("first.u").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = named.groupBy("root").agg(F.min("first").alias("top"))
    by_print = materialize(named.join(tops, "root").select("print", "top"), "classes")
    return signed.select("u", "id", "print").join(by_print, "print").select("u", "id", F.col("top.id").alias("class"), (F.col("u") == F.col("top.u")).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), kept (it stands for the class).

    Two documents with a similarity of ``least`` or more are in one class, as are documents that a chain of such links joins. ``weighted``
    counts how often a shingle occurs (weighted Jaccard); else every distinct shingle weighs one.
    """
    found = _classes(docs, key, text, least, weighted)
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "kept")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One document of every class, all columns kept."""
    (u,) = fresh(docs, "_u")
    gone = _classes(docs, key, text, least, weighted).where("not kept").select(F.col("u").alias(u))
    return docs.withColumn(u, F.monotonically_increasing_id()).join(gone, u, "left_anti").drop(u)
