"""Documents linked by the Jaccard similarity of their word shingles, by a grouped prefix join. No pair is lost.

All shingles have one order, rare ones first. Two sets of n and m shingles can only share enough if the first
n - ceil(0.9 n) + 1 of the one and the first m - ceil(0.9 m) + 1 of the other, their prefixes, have a shingle in common. Documents with the
same prefix and size form a group, and groups meet in the buckets of their prefix shingles. There, pairs of groups are filtered by their sizes
and by the places of the shared shingle, and what is left is expanded to members that are compared on whole sets.

The stages, each written:

1. a sketch of ``CELLS`` counters over all shingles, added up over tasks, gives the order (counter, hash); its size is fixed;
2. one pass over the texts: size, fingerprint, prefix and a histogram of every set;
3. equal sets are one from here on, sets of equal prefix and size a group; prefix shingles of several sets make buckets;
4. every group's largest bucket is cut by hash into blocks of about ``BLOCK`` sets and compared block by block, once more under another hash
   where there are several blocks. This costs one look at every set and joins nearly all that belongs together;
5. what is still apart: in every bucket that holds several components, the members outside its largest one are compared with all members of
   a similar size, block against block, where those of a similar size are of several components at all. Members of one component, and those that met in a bucket of one block, need no comparison, so this is
   exact;
6. the components of all links.

Before any sets meet, rows of some numbers do and are filtered by size and place, then those left by their histograms, whose common part is
never less than that of the sets. Only for documents of pairs that pass both the sets are taken from the texts again.

A task holds two blocks, bounded by sets and by bytes, however many documents share a shingle; a block pair returns a spanning forest of its
links. Documents are told apart by their place in the input, so ``docs`` must be a table scan (or another frame that yields the same partitions
each time it is read).

Defined cases: null and empty texts, and those of blanks only, have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are linked like any others; null doc_ids are larger than any other, and a component of only such rows has a
null id; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.llm.components import components
from veilframe.llm.memory import release
from veilframe.storage import materialize, materialize_counted

SHINGLE, PERCENT = 3, 90
CELLS, PIECES = 1 << 20, 16  # counters of the sketch, sent in pieces
BLOCK, BLOCK_BYTES, BROADCAST_ROWS = 512, 1 << 24, 200_000
TEXT_CHUNK = 1 << 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text; A-Z count as a-z, six blanks part words."""
    from xxhash import xxh3_64_intdigest

    data, parts, at = (text or b"").lower(), [], 0
    while at < len(data):
        end = at + TEXT_CHUNK
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the shingles in order of appearance; a short text is one."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, min(SHINGLE, len(h))):
            out = out * _STEP + h[i : n + i]
    return mix(out)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)) & np.uint64(CELLS - 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    waiting, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            waiting.append(_cells(shingles(text)))
            size += len(waiting[-1])
            if size > CELLS:
                counts += np.bincount(np.concatenate(waiting).view(np.int64), minlength=CELLS)
                waiting, size = [], 0
    if waiting:
        counts += np.bincount(np.concatenate(waiting).view(np.int64), minlength=CELLS)
    yield from _pieces(counts)
    release()


def _pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if counts.any():
        parts = [x.astype("<i8").tobytes() for x in counts.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0), batch.column(1)):
            new = np.frombuffer(counts.as_py(), "<i8")
            sums[piece.as_py()] = sums.get(piece.as_py(), 0) + new
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"])


def sketch(texts: DataFrame) -> np.ndarray:
    """Counters of all shingles of all texts, capped at 32 bits where only the order matters."""
    kind = "piece int, counts binary"
    parts = texts.mapInArrow(_sketch, kind).repartition(PIECES, "piece").mapInArrow(_add, kind).collect()  # a fixed 8 MB
    counts = np.zeros((PIECES, CELLS // PIECES), np.int64)
    for r in parts:
        counts[r.piece] = np.frombuffer(bytes(r.counts), "<i8")
    return np.minimum(counts.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def histogram(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 2^k equal ranges of the hash, about two a range. Two sets have at most the sum of the
    smaller counts in common. Empty where a range holds more than a byte can say."""
    k = min(22, max(4, len(s).bit_length() - 2))
    counts = np.bincount((s >> np.uint64(64 - k)).view(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _sign(batches: Iterator[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """(u, id, text) to size, fingerprint of the set, fingerprint of prefix and size, prefix."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes, prints, groups, prefixes, ranges = [], [], [], [], []
            for text in part.column(2).to_pylist():
                s = np.unique(shingles(text))
                p = prefix_size(len(s), percent) if len(s) else 0
                first = s[np.lexsort((s, counts[_cells(s)]))[:p]]
                sizes.append(len(s))
                prints.append(xxh3_128_digest(s.tobytes()))
                groups.append(xxh3_128_digest(len(s).to_bytes(8, "little") + first.tobytes()))
                prefixes.append(first.view(np.int64))
                ranges.append(histogram(s))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(groups, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(ranges, pa.binary())],
                ["u", "id", "n", "print", "group", "prefix", "ranges"],
            )
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, places, text) to a row of the set for each place it is compared in."""
    names = ["bucket", "i", "j", "u", "side", "place", "set"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out, size = [], 0
        for u, places, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.unique(shingles(text)).tobytes()
            for p in places:
                out.append((p["bucket"], p["i"], p["j"], u, p["side"], p["place"], found))
                size += len(found)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    release()


ASKING, ASKED, BOTH = 0, 1, 2


def _may_link(place: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that size and place allow: with the shared shingle at places i and j, at most min(i, j) shingles before it and
    min(n - i, m - j) from it on are common."""
    i, j, n, m = place[one][:, None], place[two][None], size[one][:, None], size[two][None]
    bound = np.minimum(i, j) + np.minimum(n - i, m - j)
    return (100 + percent) * bound >= percent * (n + m)


def _common_at_most(rows: list[tuple], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The most that the sets of each pair of rows can share, by their histograms (the last field)."""
    bits = np.array([len(r[-1]).bit_length() - 1 for r in rows])  # -1: none
    level, out = np.minimum(bits[one], bits[two]), np.full(len(one), np.iinfo(np.int64).max)
    for k in np.unique(level[level >= 0]):
        pairs = np.flatnonzero(level == k)
        used = np.unique(np.concatenate([one[pairs], two[pairs]]))
        table = np.stack([np.frombuffer(rows[x][-1], np.uint8).reshape(1 << k, -1).sum(axis=1, dtype=np.int32) for x in used])
        first, second = np.searchsorted(used, one[pairs]), np.searchsorted(used, two[pairs])
        step = max(1, (1 << 21) >> k)
        for at in range(0, len(pairs), step):
            part = slice(at, at + step)
            out[pairs[part]] = np.minimum(table[first[part]], table[second[part]]).sum(axis=1)
    return out


def _prune(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, u, side, place, n, root, met[, ranges]), those of a block pair together: the ones that a pair may link.

    Pairs of one root are linked already, and pairs with the same ``met`` have been compared. With ``ranges`` pairs whose histograms
    leave too little in common go, too.
    """
    names = ["bucket", "i", "j", "u", "side", "place", "n", "root", "met"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    out: list[tuple] = []

    def add(key: tuple, rows: list[tuple]) -> None:
        one, two = ([r for r in rows if r[1] != x] for x in (ASKED, ASKING))
        if len(one) * len(two) <= 64 and len(rows[0]) == 6:
            keep = set()
            for a in one:
                for b in two:
                    i, j, n, m = a[2], b[2], a[3], b[3]
                    near = (100 + percent) * (min(i, j) + min(n - i, m - j)) >= percent * (n + m)
                    if near and a[4] != b[4] and (a[5] is None or a[5] != b[5]):
                        keep |= {a, b}
            out.extend((*key, *r) for r in rows if r in keep)
            return
        side, place, size, root = (np.array([r[x] for r in rows], np.int64) for x in (1, 2, 3, 4))
        met, known = np.array([r[5] or 0 for r in rows], np.int64), np.array([r[5] is not None for r in rows])
        first, second = np.flatnonzero(side != ASKED), np.flatnonzero(side != ASKING)
        may = _may_link(place, size, first, second, percent) & (root[first][:, None] != root[second][None])
        may &= ~((met[first][:, None] == met[second][None]) & known[first][:, None] & known[second][None])
        at, to = np.nonzero(may)
        one, two = first[at], second[to]
        if len(rows[0]) > 6 and len(one):
            most = np.minimum(_common_at_most(rows, one, two), size[one])
            near = (100 + percent) * most >= percent * (size[one] + size[two])
            one, two = one[near], two[near]
        out.extend((*key, *rows[x][:6]) for x in np.unique(np.concatenate([one, two])))

    def taken() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        out.clear()
        return batch

    key, rows = None, []
    for batch in batches:
        for *k, u, side, place, n, root, met in _rows(batch):
            if k != key:
                if rows:
                    add(key, rows)
                key, rows = k, []
            rows.append((u, side, place, n, root, *met))
        if len(out) > 50_000:
            yield taken()
    if rows:
        add(key, rows)
    yield taken()
    release()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The first eight columns of each row, then the others as one."""
    columns = [c.to_pylist() for c in batch.columns]
    return zip(*columns[:8], zip(*columns[8:]))


def links_between(rows: list[tuple[int, int, int, bytes]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a block pair of one bucket, as a spanning forest. A row: u, side, place of the shingle in the prefix, set.

    Pairs that pass the filter by size and place are compared by products over the shingles that two sets hold; shingles held by the
    same sets, as most of near copies are, count as one column with a weight.
    """
    sets = [np.frombuffer(s, np.uint64) for *_, s in rows]
    u, side, place = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    size = np.array([len(s) for s in sets], np.int64)
    one, two = np.flatnonzero(side != ASKED), np.flatnonzero(side != ASKING)
    least = lambda a, b: percent * (size[a][:, None] + size[b][None])
    may = _may_link(place, size, one, two, percent) & (u[one][:, None] != u[two][None])
    one, two, may = one[may.any(axis=1)], two[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    if not len(one):
        return []
    both = np.unique(np.concatenate([one, two]))
    all_, owner = np.concatenate([sets[x] for x in both]), np.repeat(np.arange(len(both)), size[both])
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    marks = mix(np.arange(1, len(both) + 1, dtype=np.uint64) * _STEP)
    holders, count = np.bitwise_xor.reduceat(marks[owner], first), np.diff(np.append(first, len(owner)))
    shared = np.flatnonzero(count > 1)
    _, where, weight = np.unique(holders[shared], return_index=True, return_counts=True)
    chosen = shared[where]  # one shingle for all with the same holders
    owner, sizes = _runs(owner, first[chosen], count[chosen])
    column = np.repeat(np.arange(len(chosen)), sizes)
    common = np.zeros((len(one), len(two)), np.int64)
    rows_one, rows_two = np.searchsorted(both, one), np.searchsorted(both, two)
    width = max(1, (1 << 22) // len(both))
    for at in range(0, len(chosen), width):
        part = np.zeros((len(both), width), np.float32)
        lo, hi = np.searchsorted(column, [at, at + width])
        part[owner[lo:hi], column[lo:hi] - at] = 1
        heavy = np.zeros(width, np.float32)
        heavy[: len(weight[at : at + width])] = weight[at : at + width]
        common += ((part[rows_one] * heavy) @ part[rows_two].T).astype(np.int64)
    near = may & ((100 + percent) * common >= least(one, two))
    return [(int(u[one[a]]), int(u[two[b]])) for a, b in _forest(near)]


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that keep rows and columns connected as ``near`` connects them."""
    new_row, new_column = near.any(axis=1), near.any(axis=0)
    for start in range(len(near)):
        if not new_row[start]:
            continue
        new_row[start], rows = False, np.array([start])
        while len(rows):
            columns = np.flatnonzero(near[rows].any(axis=0) & new_column)
            new_column[columns] = False
            yield from zip(rows[near[np.ix_(rows, columns)].argmax(axis=0)], columns) if len(columns) else ()
            rows = np.flatnonzero(near[:, columns].any(axis=1) & new_row)
            new_row[rows] = False
            yield from zip(rows, columns[near[np.ix_(rows, columns)].argmax(axis=1)]) if len(rows) else ()


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, u, side, place, set), those of a block pair one after the other."""

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        for *k, u, side, place, s in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                yield batch_of(links_between(rows, percent) if rows else [])
                key, rows = k, []
            rows.append((u, side, place, s))
    yield batch_of(links_between(rows, percent) if rows else [])
    rows.clear()
    release()


def _blocks(members: Column, load: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(load * 8 / BLOCK_BYTES), F.lit(1)).cast("int")


def _links(placed: DataFrame, signed: DataFrame, texts: DataFrame, percent: int, name: str) -> DataFrame:
    """Compare ``placed`` (bucket, i, j, u, side, place, n, root, met): rows of some numbers first, with the histograms of those that
    are left, and then the whole sets of what is left of these."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell, fields = ["bucket", "i", "j"], ["bucket", "i", "j", "u", "side", "place", "n", "root", "met"]
    schema = "bucket long, i int, j int, u long, side int, place int, n long, root long, met long"

    def pruned(rows: DataFrame, step: str) -> tuple[DataFrame, int]:
        laid = rows.repartition(n, *cell).sortWithinPartitions(*cell)
        return materialize_counted(laid.mapInArrow(lambda it: _prune(it, percent), schema), f"{name}-{step}")

    def beside(rows: DataFrame, count: int) -> DataFrame:
        return F.broadcast(rows) if count <= BROADCAST_ROWS else rows

    near, count = pruned(placed.select(*fields), "placed")
    nearer, count = pruned(signed.select("u", "ranges").join(beside(near, count), "u").select(*fields, "ranges"), "nearer")
    places = nearer.groupBy("u").agg(F.collect_list(F.struct("bucket", "i", "j", "side", "place")).alias("places"))
    joined = texts.select("u", "t").join(beside(places, count), "u").select("u", "places", "t")
    sets = joined.mapInArrow(_sets, "bucket long, i int, j int, u long, side int, place int, set binary")
    laid = sets.repartition(n, *cell).sortWithinPartitions(*cell)
    return materialize(laid.mapInArrow(lambda it: _compare(it, percent), "a long, b long"), name)


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    return members.join(components(links).withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))


def with_other_roots(rows: DataFrame) -> DataFrame:
    """Rows (bucket, class, root, ..) that have a row of another root in a class at most one apart; ``classes``: those of them that do.

    It is told from the smallest and largest root of every bucket and class, of which a bucket has few.
    """
    roots = rows.groupBy("bucket", "class").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    by_class = W.partitionBy("bucket").orderBy("class")
    near = F.array(*[F.first(F.struct("class", "low", "high")).over(by_class.rangeBetween(d, d)) for d in (-1, 0, 1)])
    near = roots.select("bucket", "class", near.alias("near"), F.min("low").over(by_class.rangeBetween(-1, 1)).alias("low"), F.max("high").over(by_class.rangeBetween(-1, 1)).alias("high"))
    met = rows.join(near.where("low <> high").select("bucket", "class", "near"), ["bucket", "class"])
    other = F.filter("near", lambda x: x.isNotNull() & ((x["low"] != F.col("root")) | (x["high"] != F.col("root"))))
    return met.withColumn("classes", F.transform(other, lambda x: x["class"])).drop("near").where(F.size("classes") > 0)


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links of ``percent`` or more lead to)."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    counts = spark.sparkContext.broadcast(sketch(texts.select("t")))
    schema = f"u long, id {kind}, n long, print binary, group binary, prefix array<long>, ranges binary"
    signed = materialize(texts.mapInArrow(lambda it: _sign(it, counts.value, percent), schema), "signed")

    first = F.min(F.struct(F.col("id").isNull(), "id", "u")).alias("first")
    one = signed.groupBy("print").agg(first, F.min("n").alias("n"), F.min("group").alias("group"), F.first("prefix").alias("prefix"))
    sets = materialize(one.where("n > 0").select("print", "first", F.col("first.u").alias("u"), "n", "group", "prefix"), "sets")
    groups = materialize(sets.groupBy("group").agg(F.min("u").alias("g"), F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    tokens = groups.select("g", "m", "n", F.posexplode("prefix").alias("place", "bucket"))
    sizes = tokens.groupBy("bucket").agg(F.sum("m").alias("all_m"), F.sum(F.col("n") * F.col("m")).alias("load")).where("all_m > 1")
    met = materialize(tokens.join(sizes, "bucket").select("bucket", "g", "place", "all_m", "load"), "met")

    home = met.groupBy("g").agg(F.max(F.struct("all_m", "bucket", "place", "load")).alias("h"))
    members = materialize(sets.join(groups.select("group", "g"), "group").join(home, "g").select("u", "g", "n", "h.*"), "members")

    blocks = _blocks(F.col("all_m"), F.col("load"))

    def at_home(rows: DataFrame, salt: int) -> DataFrame:
        block = F.pmod(F.xxhash64("u", F.lit(salt)), blocks).cast("int")
        nowhere = F.lit(None).cast("long").alias("met")
        return rows.select("bucket", block.alias("i"), block.alias("j"), "u", F.lit(BOTH).alias("side"), "place", "n", F.col("u").alias("root"), nowhere)

    links = _links(at_home(members, 1), signed, texts, percent, "links")
    large = members.where(blocks > 1)
    links = links.unionByName(_links(at_home(large, 2), signed, texts, percent, "more-links"))
    rooted = materialize(_rooted(members.select("u", "g", "n", F.when(blocks == 1, F.col("bucket")).alias("met")), links), "rooted")

    # what is still apart; sizes that fit are a class apart at most
    width = math.log(100 / percent) * 1.001 if percent < 100 else 1e-9
    apart = met.select("bucket", "g", "place").join(rooted, "g")
    parts = apart.groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("m"), F.min("u").alias("least"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y"),
        F.min("met").alias("low"), F.max("met").alias("high"), F.count("met").alias("at_home"),
    )
    per = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m"), F.min("least").alias("least"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        ((F.min("low") == F.max("high")) & (F.sum("at_home") == F.sum("m"))).alias("done"),  # all members were compared with each other
    )
    once = per.where("roots > 1 AND NOT coalesce(done, false)").groupBy("m", "least", "x", "y").agg(F.min(F.struct("bucket", F.col("top.root").alias("top"))).alias("b")).select("b.*")
    class_ = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    still = materialize(apart.join(once, "bucket").select("bucket", "u", "place", "n", "root", "met", (F.col("root") != F.col("top")).alias("asks"), class_.alias("class")), "open")
    open_ = materialize(with_other_roots(still), "open-near")
    asking = open_.where("asks").withColumn("class", F.explode("classes"))
    blocks_of = lambda df, name: df.groupBy("bucket", "class").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias(name))
    cells = materialize(blocks_of(open_, "asked").join(blocks_of(asking, "asking"), ["bucket", "class"]), "cells")
    cell = F.xxhash64("bucket", "class").alias("bucket")

    def spread(rows: DataFrame, own: str, other: str, side: int, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("u", F.lit(3)), F.col(own)).cast("int").alias(names[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        placed = rows.join(cells, ["bucket", "class"]).select(cell, mine, every, "u", F.lit(side).alias("side"), "place", "n", "root", "met")
        return placed.select("bucket", "i", "j", "u", "side", "place", "n", "root", "met")

    rest = spread(asking, "asking", "asked", ASKING, ("i", "j")).unionByName(spread(open_, "asked", "asking", ASKED, ("j", "i")))
    links = links.unionByName(_links(rest, signed, texts, percent, "last-links"))

    roots = components(links)
    named = sets.select("print", "first", F.col("u").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = named.groupBy("root").agg(F.min("first").alias("top"))
    by_print = materialize(named.join(tops, "root").select("print", F.col("top.id").alias("top")), "components")
    found = signed.select("id", "n", "print").join(by_print, "print", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("top")).alias("component_id"))
