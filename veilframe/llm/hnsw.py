"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by their hash; a task builds the graph of one shard of about ``SHARD_VECTORS`` vectors. Levels are built from the top
down. Within a level nodes are inserted in batches that double: a batch searches the graph so far (entered through the levels
above), takes in its own members as candidates too, keeps up to M diverse neighbours (2M on the lowest level) and links back;
overfull lists are pruned by the same rule. A shard is stored as one row: vectors, ids and one flat neighbour array per level.

Shards are dealt once to a number of places that follows the cores, not the shards, and every place gets all queries. A task holds the queries
and runs through its shards one after the other, so neither the driver nor a task ever holds queries times shards; queries beyond ``HELD`` numbers,
or too few shards for the cores, make several groups of queries, each of which meets all shards. A beam of ``EF`` nodes walks the lowest level,
a block of queries in step, and all nodes it found are scored again in double precision on the original vectors. Where the beam's last node ties
with the k-th id within float32 error, or gives fewer than k ids, the query is compared with the whole shard. Each place returns ``k`` ids per
query; a ranking over places follows.

Equal vectors are one node that knows its ``k + 1`` smallest ids, which is all that a result can show of them; so a vector
that a third of the rows share costs one node. The limit is applied before the shuffle.

Defined cases: null ids, null, empty and zero vectors and vectors with null or non-finite components take no part, neither as
query nor as candidate; vectors of different lengths never meet; repeated (id, vector) rows count once and rows with a query's own id
are not its candidates; queries that share an id are one query, whose candidates count with their best score; fewer candidates than k give fewer rows; no vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.storage import materialize, materialize_counted, materialize_measured

M, EF, EF_BUILD, SHARD_VECTORS, BLOCK = 16, 96, 64, 2048, 1024
#: Numbers (of query vectors) that a task holds, and tasks per core of a search.
HELD, WAVES = 1 << 22, 4


class Graph:
    """Levels of a shard: ``links[l]`` is a flat (nodes x width) array of neighbours, -1 where there is none."""

    def __init__(self, unit: np.ndarray, counts: list[int], links: list[np.ndarray]):
        self.unit, self.counts, self.links = unit, counts, links  # nodes 0..counts[l]-1 reach up to level l

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 1) -> Graph:
        n = len(unit)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        counts = [int((level >= l).sum()) for l in range(level.max() + 1)] if n else []
        graph = cls(unit, counts, [np.zeros((0, 0), np.int32)] * len(counts))  # any n nodes may be the upper ones: places are by hash
        for l in range(len(counts) - 1, -1, -1):
            graph._build_level(l)
        return graph

    def _build_level(self, l: int) -> None:
        n, width = self.counts[l], 2 * M if l == 0 else M
        self.links[l] = np.full((n, width), -1, np.int32)
        done = min(n, width + 1)
        self._link(l, np.arange(done), [np.delete(np.arange(done), i) for i in range(done)], width)
        while done < n:
            batch = np.arange(done, min(n, done * 2, done + 512))
            found, _ = self.beam(self.unit[batch], EF_BUILD, l, done)
            near = self.unit[batch] @ self.unit[batch].T
            np.fill_diagonal(near, -np.inf)
            k = min(width, len(batch) - 1)
            own = batch[np.argpartition(-near, k - 1, axis=1)[:, :k]] if k else np.zeros((len(batch), 0), int)
            self._link(l, batch, np.concatenate([found, own], axis=1), width)
            done = batch[-1] + 1

    def _link(self, l: int, nodes: np.ndarray, candidates, width: int) -> None:
        """Give nodes their neighbours among the candidates, link back, prune."""
        table = np.full((len(nodes), max(map(len, candidates), default=0)), -1, np.int64)
        for i, c in enumerate(candidates):
            table[i, : len(c)] = c
        chosen = self._diverse(nodes, table, width)
        self.links[l][nodes] = chosen
        a, b = np.repeat(nodes, width), chosen.reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        if not len(b):
            return
        targets = np.unique(b)
        old = self.links[l][targets]
        a, b = np.concatenate([a, old[old >= 0]]), np.concatenate([b, np.repeat(targets, (old >= 0).sum(1))])
        pair = np.unique(np.stack([b, a], 1), axis=0)
        b, a = pair[:, 0], pair[:, 1]
        similar = np.einsum("ij,ij->i", self.unit[a], self.unit[b])
        order = np.lexsort((-similar, b))
        a, b = a[order], b[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        keep = place < 2 * width
        wide = np.full((len(targets), 2 * width), -1, np.int64)
        wide[np.searchsorted(targets, b[keep]), place[keep]] = a[keep]
        self.links[l][targets] = self._diverse(targets, wide, width)

    def _diverse(self, nodes: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
        """Per node up to ``width`` candidates, nearest first, passing over one that is nearer to a chosen one than to the
        node; free places go to the nearest passed over."""
        out = np.full((len(nodes), width), -1, np.int32)
        for at in range(0, len(nodes), 128):
            own, cand = nodes[at : at + 128], table[at : at + 128]
            if not cand.shape[1]:
                continue
            vectors = self.unit[np.maximum(cand, 0)]
            similar = np.where((cand >= 0) & (cand != own[:, None]), np.einsum("rcd,rd->rc", vectors, self.unit[own]), -np.inf)
            order = np.argsort(-similar, axis=1, kind="stable")
            cand, similar = np.take_along_axis(cand, order, 1), np.take_along_axis(similar, order, 1)
            vectors = np.take_along_axis(vectors, order[:, :, None], 1)
            among = vectors @ vectors.transpose(0, 2, 1)
            ok = np.isfinite(similar)
            ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
            blocked = np.zeros(cand.shape, bool)
            taken, number = np.zeros(cand.shape, bool), np.zeros(len(own), int)
            for c in range(cand.shape[1]):
                pick = ok[:, c] & ~blocked[:, c] & (number < width)
                taken[:, c], number = pick, number + pick
                blocked |= pick[:, None] & (among[:, c] > similar)
            rank = np.where(taken, 0, np.where(ok, 1, 2))
            order = np.argsort(rank, axis=1, kind="stable")[:, :width]
            chosen = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(cand, order, 1), -1)
            out[at : at + 128, : chosen.shape[1]] = chosen
        return out

    def _entry(self, queries: np.ndarray, l: int, size: int) -> np.ndarray:
        """Per query the node that greedy walks on the levels above ``l`` end at."""
        at = np.zeros(len(queries), np.int64)
        for up in range(len(self.counts) - 1, l, -1):
            now = np.einsum("rd,rd->r", self.unit[at], queries)
            while True:
                near = self.links[up][at]
                similar = np.where(near >= 0, np.einsum("rmd,rd->rm", self.unit[np.maximum(near, 0)], queries), -np.inf)
                best = similar.argmax(1) if near.shape[1] else np.zeros(len(at), int)
                top = similar[np.arange(len(at)), best] if near.shape[1] else now
                better = top > now
                if not better.any():
                    break
                at, now = np.where(better, near[np.arange(len(at)), best] if near.shape[1] else at, at), np.maximum(now, top)
        return np.where(at < size, at, 0)

    def beam(self, queries: np.ndarray, ef: int, l: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``ef`` nodes a walk on level ``l`` finds, -1 where fewer; all queries in step."""
        size = self.counts[l] if size is None else size
        n, links = len(queries), self.links[l]
        nodes, score = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32)
        nodes[:, 0] = self._entry(queries, l, size)
        score[:, 0] = np.einsum("rd,rd->r", self.unit[nodes[:, 0]], queries)
        open_, worst = score.copy(), score.min(1)  # scores of nodes no walk went on from
        seen = np.zeros((n, size + 1), bool)  # the last one stands for no neighbour
        seen[np.arange(n), nodes[:, 0]] = seen[:, size] = True
        live = np.arange(n)
        while len(live):
            best = open_[live].argmax(1)
            more = open_[live, best] > -np.inf
            live, best = live[more], best[more]
            open_[live, best] = -np.inf
            near = links[nodes[live, best]]
            near = np.where((near < 0) | (near >= size), size, near) + live[:, None] * (size + 1)
            fresh = near[~seen.take(near)]
            seen.reshape(-1)[fresh] = True
            q, new = np.divmod(fresh, size + 1)
            similar = np.einsum("ij,ij->i", self.unit[new], queries[q])
            better = similar > worst[q]  # others have no place in a full beam
            q, new, similar = q[better], new[better], similar[better]
            at, number = np.unique(q, return_counts=True)
            if not len(at):
                continue
            row, column = np.repeat(np.arange(len(at)), number), ef + np.arange(len(q)) - np.repeat(np.cumsum(number) - number, number)
            wide = ef + number.max()
            all_score = np.full((len(at), wide), -np.inf, np.float32)
            all_nodes, all_open = np.full((len(at), wide), -1, np.int64), all_score.copy()
            all_score[:, :ef], all_nodes[:, :ef], all_open[:, :ef] = score[at], nodes[at], open_[at]
            all_score[row, column], all_nodes[row, column], all_open[row, column] = similar, new, similar
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef] + np.arange(len(at))[:, None] * wide
            nodes[at], score[at], open_[at] = all_nodes.take(top), all_score.take(top), all_open.take(top)
            worst[at] = score[at, -1]
        return nodes, score


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two, so that nothing over- or underflows, and their norms."""
    x = x * 2.0 ** -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]
    return x, np.sqrt((x * x).sum(-1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    (a, m), (b, n) = _scaled(a), _scaled(b)
    return (a * b).sum(-1) / (m * n)


def _build(frame):
    import pandas as pd

    frame = frame.sort_values("order", kind="stable")
    vectors = np.stack(frame["vec"].to_list()).astype(np.float64)
    graph = Graph.build(unit(vectors))
    ids = frame["ids"].to_list()
    row = {
        "shard": frame["shard"].iloc[0], "dim": vectors.shape[1], "vectors": vectors.tobytes(), "ids": np.concatenate(ids).astype("<i8").tobytes(),
        "id_counts": np.array([len(x) for x in ids], "<i4").tobytes(), "counts": graph.counts, "links": [x.astype("<i4").tobytes() for x in graph.links],
    }
    return pd.DataFrame([row])


INDEX = "shard long, dim int, vectors binary, ids binary, id_counts binary, counts array<int>, links array<binary>"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _clean(table: DataFrame, key: str, vector: str) -> DataFrame:
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vec")))


def build_index(table: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """One written row per shard, holding every usable vector for searches of up to ``k`` neighbours."""
    first = W.partitionBy("vec").orderBy("id")
    rows = _clean(table, key, vector).withColumn("nr", F.dense_rank().over(first)).where(F.col("nr") <= k + 1)
    distinct, n = materialize_counted(rows.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    shards = max(1, -(-n // shard_vectors))
    dealt = distinct.withColumn("order", F.xxhash64("vec")).withColumn("shard", F.pmod("order", F.lit(shards))).withColumn("dim", F.size("vec"))
    # a second hash inside the shard, as the first one chose the shard
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(1), "vec"))
    index = dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX)
    return materialize(index, "hnsw")


def _nearest(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of every query ``r`` by (score, id), each id with its best score."""
    order = np.lexsort((-score, ids, r))
    r, ids, score = r[order], ids[order], score[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (ids[1:] != ids[:-1])
    r, ids, score = r[first], ids[first], score[first]
    order = np.lexsort((ids, -score, r))
    r, ids, score = r[order], ids[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], ids[keep], score[keep]


class Shard:
    """A shard's graph with its vectors in double precision and their ids."""

    def __init__(self, row: dict):
        vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        links = [np.frombuffer(x, "<i4").reshape(c, -1) for x, c in zip(row["links"], row["counts"])]
        self.graph = Graph(unit(vectors), row["counts"], links)
        self.vectors, self.norms = _scaled(vectors)
        self.counts, self.ids = np.frombuffer(row["id_counts"], "<i4"), np.frombuffer(row["ids"], "<i8")
        self.starts = np.cumsum(self.counts) - self.counts
        # what a sum of float32 products of unit vectors can be off by
        self.error = 2 * (row["dim"] + 4) * 2.0**-24

    def _exact(self, queries: np.ndarray, own: np.ndarray, r: np.ndarray, nodes: np.ndarray, k: int):
        """(query, id, cosine): the ``k`` best ids among the pairs of queries ``r`` and ``nodes``, all compared in double."""
        (queries, norms), score, step = _scaled(queries), np.empty(len(r)), max(1, (1 << 20) // queries.shape[1])
        for at in range(0, len(r), step):
            a, b = r[at : at + step], nodes[at : at + step]
            score[at : at + step] = (queries[a] * self.vectors[b]).sum(-1) / (norms[a] * self.norms[b])
        times = self.counts[nodes]
        at = np.repeat(self.starts[nodes], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        r, ids, score = np.repeat(r, times), self.ids[at], np.repeat(score, times)
        other = ids != own[r]
        return _nearest(r[other], ids[other], score[other], k)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) of the ``k`` nearest found of every query, without the id ``own`` it has itself."""
        single = unit(queries)
        nodes, score = self.graph.beam(single, max(ef, k + 1))
        r, c = np.nonzero(nodes >= 0)
        found = self._exact(queries, own, r, nodes[r, c], k)
        # the k-th score so far, and the beam's last: where they tie within the error, others outside the beam may be as near
        number = np.bincount(found[0], minlength=len(queries))
        least, full = np.full(len(queries), -np.inf), number == k
        least[full] = found[2][np.cumsum(number)[full] - 1]
        last = np.where(nodes >= 0, score, np.inf).min(1)
        again = np.flatnonzero(((nodes >= 0).sum(1) < len(self.vectors)) & (last + self.error >= least))
        parts = [[x[~np.isin(found[0], again)] for x in found]]
        for at in range(0, len(again), 64):
            some = again[at : at + 64]
            r, c = np.nonzero(single[some] @ self.graph.unit.T + self.error >= least[some][:, None])
            q, ids, cosines = self._exact(queries[some], own[some], r, c, k)
            parts.append([some[q], ids, cosines])
        return tuple(np.concatenate(x) for x in zip(*parts))


SHARD = ["vectors", "ids", "id_counts", "counts", "links"]


def _search(batches: Iterator[pa.RecordBatch], k: int, ef: int, block: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of every query in the partition's shards. Rows come by group and length, queries first; shards are opened one at a time."""
    at, own, queries, best = None, [], [], None

    def told():
        if best is not None:
            r, ids, score = best
            yield pa.RecordBatch.from_arrays([pa.array(own[r], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = batch["held"][i].as_py(), batch["dim"][i].as_py()
            if now != at:
                yield from told()
                at, own, queries, best = now, [], [], None
            if batch["queries"][i].is_valid:
                asked = batch["queries"][i].values
                own.append(np.array(asked.field("id")))
                queries.append(np.array(asked.field("vec").flatten()).reshape(-1, now[1]))
            elif len(own):
                if best is None:
                    own, queries = np.concatenate(own), np.concatenate(queries)
                    best = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
                shard = Shard({c: batch[c][i].as_py() for c in ["dim", *SHARD]})
                parts = [best]
                for a in range(0, len(own), block):
                    r, ids, score = shard.search(queries[a : a + block], own[a : a + block], k, ef)
                    parts.append((r + a, ids, score))
                best = _nearest(*(np.concatenate(x) for x in zip(*parts)), k)
    yield from told()


def _laid(index: DataFrame, queries: DataFrame, numbers: int, n: int, block: int, held: int) -> DataFrame:
    """Blocks of queries and shards where they meet: a partition has its shards once for each group of queries, the queries before them."""
    shards, tasks = (index.agg(F.max("shard")).first()[0] or 0) + 1, WAVES * index.sparkSession.sparkContext.defaultParallelism
    places, blocks = min(shards, tasks), max(1, -(-n // block))
    groups = max(-(-numbers // held), min(tasks // places, blocks))  # with few shards more groups, for the cores
    blocks = max(groups, blocks)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vec")).alias("queries"))
    asked = packed.select(every(places).alias("place"), F.pmod("block", F.lit(groups)).cast("int").alias("held"), "dim", "queries")
    met = index.select(F.pmod("shard", F.lit(places)).cast("int").alias("place"), every(groups).alias("held"), "dim", "shard", *SHARD)
    # no join: its planner takes the queries for small, however many shards they are to meet, and gathers them in the driver
    both = asked.unionByName(met, allowMissingColumns=True)
    return both.repartitionById(places * groups, F.col("place") * F.lit(groups) + F.col("held")).sortWithinPartitions("held", "dim", F.col("shard").asc_nulls_first())


def search(
    index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", ef: int = EF, block: int = BLOCK, held: int = HELD
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every query, ties to the smaller vec_id."""
    asked, n, numbers = materialize_measured(_clean(queries, key, vector).distinct().withColumn("dim", F.size("vec")), "queries", F.size("vec"))
    laid = _laid(index, asked, numbers, n, block, held)
    found = laid.select("held", "dim", "queries", *SHARD).mapInArrow(lambda it: _search(it, k, ef, block), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
