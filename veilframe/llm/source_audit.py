"""How far the sources of a language lie apart, counted through a minimal acyclic transducer of the vocabulary.

A language's vocabulary is the terms of at least ``MIN_DOCS`` of its documents. Its sorted terms, cut into slices of
``SLICE_TERMS`` or ``SLICE_BYTES``, are built into minimal acyclic transducers: automata with shared suffixes in which every
transition adds the number of terms before it, so that an accepted term comes out as its number in byte order. The texts are then
streamed through them again: what is counted, shuffled, compared and ranked from there on are ordinals of 8 bytes, whose order breaks
ties, and only the reported ones are turned back into terms by walking the transducer down.

The stages, each written or pre-aggregated in its task before a shuffle:

1. document frequencies per language, one pass over the texts, counted per task;
2. slices of kept terms by ranges of (language, term), one transducer each, written;
3. counts per (language, source, ordinal), a second pass over the texts. Transducers of ``BROADCAST_BYTES`` together are broadcast; where
   they take more, the counted terms travel to their slice instead;
4. divergence of every two sources: rows of one term lie together, tasks fill blocks of terms x sources and keep one sum per pair, so
   neither terms nor texts are ever paired;
5. divergence of every source from its language, term by term, cut to the first ``TOP`` in every task.

All numbers are whole: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q).

Sizes: tasks hold ``HELD`` counted terms or ``PAIRS`` counted ordinals, a batch of texts and one slice (or the broadcast); the driver a row per slice and one per (lang,
source). A kept term is a path in the automaton, so one of many MB would make as many states.

Defined cases: null text, lang and source are empty; texts without terms count as documents of their group; repeated rows are separate
documents; a language without kept terms has pairs of value 0 and no terms; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.llm.memory import release
from veilframe.storage import materialize

MIN_DOCS, TOP = 3, 200
SLICE_TERMS, SLICE_BYTES, BROADCAST_BYTES = 100_000, 1 << 21, 1 << 26
HELD, PAIRS, CHUNK, BLOCK_BYTES, CELLS, SOURCES_AT_ONCE = 200_000, 1_500_000, 1 << 20, 1 << 23, 1 << 19, 256
#: A-Z to lower case; all other ASCII but a-z parts terms.
_FOLD = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    data, at = (text or b"").translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Transducer:
    """Minimal acyclic automaton from terms to their numbers in byte order, as flat arrays."""

    def __init__(self, edges: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray):
        #: edges: state << 8 | byte, ascending; skip: terms of the state before those through the edge; the last state is the first
        self.edges, self.target, self.skip, self.final = edges, target, skip, final

    @classmethod
    def build(cls, sorted_terms: list[bytes]) -> Transducer:
        """From distinct terms in byte order; states that accept the same endings are one."""
        known, below, path, last = {}, [], [(False, [])], b""

        def close(to: int) -> None:
            while len(path) > to:
                final, out = path.pop()
                key = (final, tuple(out))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(known)
                    below.append(final + sum(below[t] for _, t in out))
                if path:
                    path[-1][1].append((last[len(path) - 1], state))

        for term in sorted_terms:
            n = min(len(term), len(last))
            same = next((i for i in range(n) if term[i] != last[i]), n)
            close(same + 1)
            last = term
            path.extend((False, []) for _ in range(len(term) - same))
            path[-1] = (True, path[-1][1])
        close(0)
        edges, target, skip, ends = [], [], [], np.zeros(len(known), bool)
        for state, (final, out) in enumerate(known):
            ends[state], before = final, int(final)
            for byte, to in out:
                edges.append(state << 8 | byte)
                target.append(to)
                skip.append(before)
                before += below[to]
        return cls(np.array(edges, "<i8"), np.array(target, "<i4"), np.array(skip, "<i8"), ends)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each term, -1 where the vocabulary has none; all terms walk together, byte by byte."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        data, starts = np.frombuffer(b"".join(found), np.uint8), np.cumsum(sizes) - sizes
        out, number = np.full(len(found), -1, np.int64), np.zeros(len(found), np.int64)
        state, live, step = np.full(len(found), len(self.final) - 1), np.flatnonzero(sizes > 0), 0
        while len(live) and len(self.edges):
            key = state[live] << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[at] == key
            live, at, step = live[ok], at[ok], step + 1
            number[live] += self.skip[at]
            state[live] = self.target[at]
            done = sizes[live] == step
            ended = live[done]
            accepted = ended[self.final[state[ended]]]
            out[accepted] = number[accepted]
            live = live[~done]
        return out

    def term(self, number: int) -> bytes:
        """The term of a number."""
        state, out = len(self.final) - 1, bytearray()
        while not (self.final[state] and number == 0):
            low, high = np.searchsorted(self.edges, [state << 8, (state + 1) << 8])
            at = low + int(np.searchsorted(self.skip[low:high], number, "right")) - 1
            out.append(int(self.edges[at]) & 255)
            number, state = number - int(self.skip[at]), int(self.target[at])
        return bytes(out)

    def dump(self) -> bytes:
        sizes = np.array([len(self.edges), len(self.final)], "<i8")
        return b"".join(x.tobytes() for x in (sizes, self.edges, self.skip, self.target, self.final))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        n, states = np.frombuffer(data, "<i8", 2).tolist()
        edges, skip = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i8", n, 16 + 8 * n)
        return cls(edges, np.frombuffer(data, "<i4", n, 16 + 16 * n), skip, np.frombuffer(data, bool, states, 16 + 20 * n))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to document counts (lang, term, n) of the task."""
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def taken() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            counts = held[lang]
            size -= len(counts)
            counts.update(set().union(*terms(text)))
            size += len(counts)
            if size > HELD:
                yield from taken()
                size = 0
    yield from taken()
    release()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (part, lang, term) to slices."""
    now, found, size, part = None, [], 0, None

    def taken() -> Iterator[pa.RecordBatch]:
        if found:
            row = {"part": [part], "lang": [now], "first": [found[0]], "terms": [len(found)], "blob": [Transducer.build(found).dump()]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.int64()), ("blob", pa.binary())]))

    for batch in batches:
        for part_, lang, term in zip(*(c.to_pylist() for c in batch.columns)):
            if lang != now or len(found) >= SLICE_TERMS or size >= SLICE_BYTES:
                yield from taken()
                now, found, size = lang, [], 0
            part = part_
            found.append(term)
            size += len(term)
    yield from taken()


class Slices:
    """The slices of all languages: number, first term and first ordinal of each. ``blobs`` where they are broadcast."""

    def __init__(self, rows: list, blobs: list[bytes] | None):
        self.firsts, self.numbers, self.bases = defaultdict(list), defaultdict(list), []
        for i, r in enumerate(rows):  # in order of (lang, first)
            self.firsts[r.lang].append(bytes(r.first))
            self.numbers[r.lang].append(i)
            self.bases.append(r.base)
        self.blobs, self.loaded = blobs, {}

    def split(self, lang: str, found: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(slice, positions in ``found``) of a language's terms; terms before its first one are in no slice."""
        firsts = self.firsts.get(lang, [])
        if len(firsts) == 1:
            yield self.numbers[lang][0], range(len(found))
        elif firsts:
            parts = defaultdict(list)
            for i, term in enumerate(found):
                parts[bisect_right(firsts, term) - 1].append(i)
            for at, mine in parts.items():
                if at >= 0:
                    yield self.numbers[lang][at], mine

    def transducer(self, number: int) -> Transducer:
        if number not in self.loaded:
            self.loaded[number] = Transducer.load(self.blobs[number])
        return self.loaded[number]


_COUNTS = "slice long, lang string, source string, term binary, ordinal long, n long"


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each piece, folded pieces) of about ``BLOCK_BYTES``; a text that is longer is cut between terms."""
    data, cuts = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)

    def block(first: int, ends: np.ndarray, folded: bytes) -> tuple[np.ndarray, pa.Array]:
        buffers = [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(folded)]
        return np.arange(first, first + len(ends) - 1), pa.Array.from_buffers(pa.string(), len(ends) - 1, buffers)

    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_BYTES, "right")) - 1)
        folded = data[int(cuts[at]) : int(cuts[end])].to_pybytes().translate(_FOLD) if data is not None else b""
        if len(folded) <= BLOCK_BYTES:
            yield block(at, cuts[at : end + 1] - cuts[at], folded)
        else:  # one text
            start = 0
            while start < len(folded):
                stop = folded.find(b" ", start + BLOCK_BYTES)
                stop = len(folded) if stop < 0 else stop
                yield block(at, np.array([0, stop - start]), folded[start:stop])
                start = stop
        at = end


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[first]], [np.add.reduceat(n, first) if len(first) else n]


def _recount(batches: Iterator[pa.RecordBatch], slices: Slices) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts: by ordinal where the transducers are here, else by slice and term.

    The words of a block are told apart in Arrow arrays, distinct ones run through the transducer of their language, and counts of
    (group, ordinal) are merged over the blocks of the task.
    """
    groups: dict[tuple[str, str], int] = {}
    keys, counts, held = [], [], 0
    most = max(slices.bases, default=0) + SLICE_TERMS + 1  # above any ordinal

    def rows(slice_: pa.Array, group: np.ndarray, term: pa.Array, ordinal: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        names = list(groups)
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([slice_, lang, source, term, ordinal, pa.array(n)], ["slice", "lang", "source", "term", "ordinal", "n"])

    def taken() -> Iterator[pa.RecordBatch]:
        nonlocal keys, counts, held
        if keys:
            (key,), (n,) = _merged(keys, counts)
            for at in range(0, len(key), HELD):
                some = key[at : at + HELD]
                yield rows(pa.nulls(len(some), pa.int64()), some // most, pa.nulls(len(some), pa.binary()), pa.array(some % most), n[at : at + HELD])
        keys, counts, held = [], [], 0

    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        group_of = np.fromiter((groups.setdefault(pair, len(groups)) for pair in pairs), np.int64, len(pairs))
        by_lang = defaultdict(list)
        for pair in set(pairs):
            by_lang[pair[0]].append(groups[pair])
        for at, texts in _blocks(batch.column(2)):
            split = pc.ascii_split_whitespace(texts)
            words = split.flatten().dictionary_encode()
            found, codes = words.dictionary.cast(pa.binary()), words.indices.to_numpy()
            size = max(1, len(found))
            key, n = np.unique(np.repeat(group_of[at], np.diff(split.offsets.to_numpy())) * size + codes, return_counts=True)
            del split, words, codes
            group, code = key // size, key % size
            for lang, mine in by_lang.items():
                here = np.flatnonzero(np.isin(group, mine))
                used = np.unique(code[here])
                some = found.take(pa.array(used)).to_pylist()
                where = np.full(size, -1)
                for number, places in slices.split(lang, some):
                    places = np.asarray(places, np.int64)
                    if slices.blobs is None:
                        where[used[places]] = number
                        continue
                    ordinals = slices.transducer(number).numbers([some[i] for i in places])
                    where[used[places]] = np.where(ordinals >= 0, ordinals + slices.bases[number], -1)
                here = here[where[code[here]] >= 0]
                if slices.blobs is None:
                    yield rows(pa.array(where[code[here]]), group[here], found.take(pa.array(code[here])), pa.nulls(len(here), pa.int64()), n[here])
                else:
                    keys.append(group[here] * most + where[code[here]])
                    counts.append(n[here])
                    held += len(here)
            if held > PAIRS:
                keys, counts = _merged(keys, counts)
                held = len(keys[0])
                if held > PAIRS // 2:
                    yield from taken()
    yield from taken()
    release()


def _in_slice(batches: Iterator[pa.RecordBatch], bases: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice after its transducer: terms get their ordinals, ordinals their terms."""
    number, here = None, None
    for batch in batches:
        slices, blobs = batch.column(0).to_numpy(), batch.column(6)
        cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if slices[a] != number:
                number, here = slices[a], Transducer.load(blobs[a].as_py())
                a += 1
            part = batch.slice(a, b - a)
            found, ordinals = part.column(3).to_pylist(), part.column(4).to_pylist()
            new = here.numbers([t or b"" for t in found])
            ordinal = [o if o is not None else (int(x) + bases[number] if x >= 0 else None) for o, x in zip(ordinals, new.tolist())]
            term = [here.term(o - bases[number]) if o is not None else None for o in ordinals]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(term, pa.binary()), pa.array(ordinal, pa.int64()), part.column(5)], ["slice", "lang", "source", "term", "ordinal", "n"])


def _beside(rows: DataFrame, numbered: DataFrame, bases: list[int]) -> DataFrame:
    """``rows`` (as ``_COUNTS``) sent to the transducers of their slices."""
    blobs = numbered.select("slice", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("n"), "blob")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("blob", F.lit(None).cast("binary")).unionByName(blobs)
    laid = both.repartition(n, "slice").sortWithinPartitions("slice", F.col("blob").isNull())
    return laid.mapInArrow(lambda it: _in_slice(it, bases), _COUNTS)


def _share(count: Column | str, total: Column | str) -> Column:
    """1 + floor(10^9 count / total), exact."""
    n, all_ = (F.col(x) if isinstance(x, str) else x for x in (count, total))
    whole = F.lit(10**9).cast("decimal(10,0)") * n.cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, all_.cast("decimal(20,0)"))


def _distance(p: str, q: str) -> Column:
    d = F.col(p) - F.col(q)
    return F.call_function("div", d * d, F.col(q))


def _pairs(batches: Iterator[pa.RecordBatch], langs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, block, ordinal, place, p) sorted, to sums (lang, a, b, value); ``langs``: every source's p of an absent term, by place."""
    key, sums, cells, rows = None, None, None, []

    def add() -> None:
        if not rows:
            return
        absent, ordinals = langs[key[0]], np.concatenate([r[0] for r in rows])
        place, p = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        line = np.cumsum(np.concatenate([[0], ordinals[1:] != ordinals[:-1]]))
        first = key[1] * SOURCES_AT_ONCE
        step = max(1, CELLS // len(absent))
        cuts = np.searchsorted(line, np.arange(0, line[-1] + 1 + step, step))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                table = np.tile(absent, (line[hi - 1] - line[lo] + 1, 1))
                table[line[lo:hi] - line[lo], place[lo:hi]] = p[lo:hi]
                for a in range(first, min(first + SOURCES_AT_ONCE, len(absent))):
                    d = table[:, a : a + 1] - table
                    sums[a - first] += (d * d // table).sum(axis=0)
        rows.clear()

    def taken() -> Iterator[pa.RecordBatch]:
        if key is not None:
            add()
            a, b = (x.reshape(-1) for x in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a + key[1] * SOURCES_AT_ONCE), pa.array(b), pa.array(sums.reshape(-1))], ["lang", "a", "b", "value"])

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        ordinal, place, p = (batch.column(i).to_numpy() for i in (2, 3, 4))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or ordinal[i] != ordinal[i - 1]), len(keys)]
        at = 0
        for i, b in zip(range(1, len(cuts)), cuts[1:]):
            # hand over at the end of a block's rows, of many terms, and of the batch (a term may go on in the next)
            if b == len(keys) or keys[b] != keys[at] or b - at >= CELLS:
                if keys[at] != key:
                    yield from taken()
                    key, cells = keys[at], 0
                    size = len(langs[key[0]])
                    sums = np.zeros((min(SOURCES_AT_ONCE, size - key[1] * SOURCES_AT_ONCE), size), np.int64)
                if rows and cells >= CELLS and rows[-1][0][-1] != ordinal[at]:
                    add()
                    cells = 0
                rows.append((ordinal[at:b], place[at:b], p[at:b]))
                cells += b - at
                at = b
    yield from taken()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part 'pair': the divergence from every other source of the language, largest first. Part 'term': the ``TOP`` kept terms that the source
    uses more than its language does.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    frequencies = texts.mapInArrow(_frequencies, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = frequencies.where(F.col("n") >= MIN_DOCS).select("lang", "term")
    ranged = kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    built = materialize(ranged.select(F.spark_partition_id().alias("part"), "lang", "term").mapInArrow(_build, "part int, lang string, first binary, terms long, blob binary"), "slices")
    by_lang = W.partitionBy("lang").orderBy("first")  # a row a slice, here and below
    based = built.withColumn("base", F.sum("terms").over(by_lang.rowsBetween(W.unboundedPreceding, 0)) - F.col("terms"))
    rows = based.select("lang", "first", "terms", "base", F.length("blob").alias("size")).orderBy("lang", "first").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.lang] += r.terms
    numbered = built.withColumn("slice", F.row_number().over(W.orderBy("lang", "first")) - F.lit(1).cast("long")).select("slice", "blob")
    small = sum(r["size"] for r in rows) <= broadcast_bytes
    blobs = [bytes(r.blob) for r in numbered.orderBy("slice").collect()] if small else None
    held, bases = spark.sparkContext.broadcast(Slices(rows, blobs)), [r.base for r in rows]

    found = texts.mapInArrow(lambda it: _recount(it, held.value), _COUNTS)
    if not small:
        found = _beside(found, numbered, bases).where("ordinal IS NOT NULL")
    counts = materialize(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")

    vocabulary = spark.createDataFrame(list(sizes.items()), "lang string, v long")
    groups = texts.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(F.broadcast(vocabulary), "lang", "left").fillna(0, ["total", "v"])
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    placed = materialize(groups.withColumn("place", place.cast("long")).withColumn("absent", F.when(F.col("v") > 0, _share(F.lit(1), F.col("total") + F.col("v")))), "groups")

    shares = counts.join(placed.drop("absent"), ["lang", "source"]).withColumn("p", _share(F.col("n") + 1, F.col("total") + F.col("v")))
    absent = placed.where("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "absent"))).alias("x"))
    langs = spark.sparkContext.broadcast({r.lang: np.array([x.absent for x in r.x], np.int64) for r in absent.collect()})  # a number a group
    width = placed.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES_AT_ONCE).alias("blocks"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    by_term = shares.join(F.broadcast(width), "lang").select("lang", blocks, "ordinal", "place", "p")
    dealt = by_term.repartition(n, "lang", "block", "ordinal").sortWithinPartitions("lang", "block", "ordinal")
    sums = dealt.mapInArrow(lambda it: _pairs(it, langs.value), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = placed.select("lang", "source", F.col("place").alias("a"))
    two = placed.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    group = W.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    all_total = counts.groupBy("lang").agg(F.sum("n").alias("all_total")).join(vocabulary, "lang")
    q = whole.join(F.broadcast(all_total), "lang").select("lang", "ordinal", _share(F.col("all_n") + 1, F.col("all_total") + F.col("v")).alias("q"))
    above = shares.select("lang", "source", "ordinal", "p").join(q, ["lang", "ordinal"]).where("p > q").withColumn("value", _distance("p", "q"))
    top = materialize(above.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= TOP).select("lang", "source", "ordinal", "value", "rank"), "top")
    starts = spark.createDataFrame([(r.lang, i, r.base, r.base + r.terms) for i, r in enumerate(rows)], "lang string, slice long, base long, stop long")
    wanted = top.select("lang", "ordinal").distinct().join(F.broadcast(starts), "lang").where("ordinal >= base AND ordinal < stop")
    asked = wanted.select("slice", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("term"), "ordinal", F.lit(None).cast("long").alias("n"))
    named = _beside(asked, numbered, bases).select("lang", "ordinal", F.col("term").cast("string").alias("item"))
    found_terms = top.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(found_terms)
