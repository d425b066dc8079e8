"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a text are its byte triples, hashed into ``TRIPLES`` places, with one more term for words that repeat the word before
them. Counts become log(1 + count) x idf, are scaled to length one and projected on the leading ``DIMENSIONS`` directions of the labelled
documents (their singular vectors). A document's score is the mean label of its ``NEIGHBOURS`` nearest labelled documents by
cosine, each weighted by the cosine to the power ``SHARPNESS``. Products are exact: every document meets every labelled
vector, in blocks.

The classifier (idf, directions, vectors) is fitted on a sample of about ``LABELLED`` labelled documents, drawn by hash, so what
is broadcast has the same size for any corpus (1.5 MB). Scoring is a pass over the texts without a shuffle; a task holds
one batch of texts and one block of products.

Defined cases: a null or empty text has no term and gets the labelled documents' mean label, as does a text that resembles
none; without any label the score is 0.5; null labels do not count; a doc_id labelled more than once has the mean label; repeated documents are scored one by one;
rows with null doc_id are scored, never held out, never learned from; extra columns are ignored by ``score`` and kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import hash_draw
from veilframe.llm.memory import release
from veilframe.llm.text import fresh
from veilframe.storage import materialize

TRIPLES, DIMENSIONS, NEIGHBOURS, SHARPNESS, LABELLED = 2048, 64, 7, 8, 4000
#: Texts and bytes handled at a time in a task.
BLOCK, CHUNK = 256, 1 << 22


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte triples, and the share of words that repeat the one before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TRIPLES + 1, np.float32)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        a = np.frombuffer(data[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        code = ((a[:-2] * np.uint32(31) + a[1:-1]) * np.uint32(31) + a[2:]) * np.uint32(2654435761)
        out[:TRIPLES] += np.bincount(code >> np.uint32(32 - TRIPLES.bit_length() + 1), minlength=TRIPLES)
    words = data.split()
    if words:
        out[TRIPLES] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    return out


@dataclass
class Model:
    """idf per term, projection, unit vectors and labels of the labelled documents, their mean label."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x *= self.idf
        x /= np.linalg.norm(x, axis=1, keepdims=True) + np.float32(1e-9)
        x[:, TRIPLES] = np.minimum(counts[:, TRIPLES] * 4, 1)
        return x

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = self.weighted(counts) @ self.directions
        return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 1e-12, vote, self.mean), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    n = len(labels)
    seen = (counts > 0).sum(0)
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)
    model = Model(idf, np.zeros((TRIPLES + 1, 0), np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float64), float(labels.mean()) if n else 0.5)
    if n:
        x = model.weighted(counts)
        _, vectors = np.linalg.eigh(x.T @ x)
        model.directions = np.ascontiguousarray(vectors[:, -DIMENSIONS:]).astype(np.float32)
        model.vectors = model.project(counts)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), BLOCK):
            data = [term_counts(t).tobytes() for t in texts[at : at + BLOCK]]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1).slice(at, BLOCK)], ["counts", "label"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, labels = [np.zeros((0, TRIPLES + 1), np.float32)], []
    for batch in batches:
        counts += [np.frombuffer(x, np.float32)[None] for x in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    model = fit(np.concatenate(counts), np.array(labels, float))
    parts = [model.idf, model.directions, model.vectors, model.labels]
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts] + [pa.array([model.mean])], ["idf", "directions", "vectors", "labels", "mean"])


def _drawn(n: int, most: int) -> Column:
    return F.rand(11) < (most / n if n > most else 2.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = LABELLED) -> Model:
    """Fit on about ``most`` of the labelled documents that are not held out."""
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label is not null")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.avg("label").alias("label"))
    marks = marks.where(hash_draw(min(1.0, most / max(1, marks.count())), "id"))
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(marks), "id")
    drawn = found.where(_drawn(found.count(), most)).select("t", "label")
    sample = materialize(drawn.mapInArrow(_count, "counts binary, label double"), "labelled")
    # one task holds the bounded sample; the driver gets the model alone
    row = sample.coalesce(1).mapInArrow(_fit, "idf binary, directions binary, vectors binary, labels binary, mean double").first()
    idf, directions, vectors = (np.frombuffer(row[i], np.float32) for i in range(3))
    labels_ = np.frombuffer(row[3])
    width = directions.size // (TRIPLES + 1)
    return Model(idf, directions.reshape(TRIPLES + 1, width), vectors.reshape(len(labels_), -1) if len(labels_) else vectors.reshape(0, 0), labels_, row[4])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added as column ``name``."""
    # plain arrays: workers need not have the package, and classes travel with the function only
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.directions, model.vectors, model.labels, model.mean))
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                counts = np.stack([term_counts(t) for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(counts))], [*batch.schema.names, name])
        release()

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with a score of ``least`` or more, all columns kept."""
    (name,) = fresh(docs, "_quality_score")
    return score(docs, model, text, name).where(F.col(name) >= least).drop(name)
