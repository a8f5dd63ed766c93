"""Quality scores by nearest-neighbour voting in a latent semantic space.

The terms of a text are its byte pairs, hashed into ``terms`` columns and weighted by
log frequency and inverse document frequency.  A truncated singular value decomposition of
a bounded, balanced sample of labelled texts gives the latent space.  The sample's vectors
are broadcast; for every document the cosine with all of them is computed in blocks, and
the labels of the ``neighbours`` nearest vote with a power of their similarity.  Sampled texts
are counted in their tasks: what reaches the driver is one row of at most ``terms`` counts
per id and label, however long the texts are and however often an id is repeated.

Defined results: null and empty texts, and texts of one byte, have no vector; they get the
share of label 1 in the training data as their score, as does every text if there is no
training data of both labels (then 0.5 if there is none at all).  Equal similarities are
taken in the order of the sample, which is by id.  Training skips null ids, texts and labels;
a document with several labels counts with each, an id with several texts with one of them
(the one whose counts come first in byte order).  Texts of any length are read whole, in
chunks.  Other columns are passed on unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_label, unpacked, whole_row

#: Labelled rows per label, hashed terms and latent dimensions: they bound model and broadcast.
SAMPLE_ROWS, TERMS, LATENT = 1_500, 4_096, 48
NEIGHBOURS, POWER = 25, 4
CHUNK, TEXTS_AT_ONCE = 1 << 20, 256


def term_counts(data: bytes, terms: int) -> np.ndarray:
    """How often each hashed byte pair occurs."""
    counts = np.zeros(terms, dtype=np.float32)
    values = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(values) - 1, CHUNK):
        part = values[at : at + CHUNK + 1].astype(np.uint32)
        pair = ((part[:-1] * 257 + part[1:]) * np.uint32(2654435761)) >> np.uint32(8)
        counts += np.bincount(pair % terms, minlength=terms)
    return counts


def packed(counts: np.ndarray) -> bytes:
    """Places and counts of the terms that occur."""
    at = np.flatnonzero(counts)
    return at.astype("<i4").tobytes() + counts[at].astype("<f4").tobytes()


def unpacked_counts(data: bytes, terms: int) -> np.ndarray:
    counts = np.zeros(terms, dtype=np.float32)
    half = len(data) // 2
    counts[np.frombuffer(data[:half], "<i4")] = np.frombuffer(data[half:], "<f4")
    return counts


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of every row, ascending; of equal ones the first are taken."""
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    above, equal = near > least, near == least
    open_places = k - above.sum(axis=1, keepdims=True)
    taken = above | (equal & (np.cumsum(equal, axis=1) <= open_places))
    return np.nonzero(taken)[1].reshape(len(near), k)


class Model:
    """Latent vectors and labels of the sample, and the way from texts to vectors."""

    def __init__(self, counts: np.ndarray, labels: list[int], share: float | None, terms=TERMS) -> None:
        self.terms, self.share = terms, share
        self.ready = len(set(labels)) == 2
        if not self.ready:
            return
        seen = (counts > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
        weighted = self._weighted(counts)
        self.base = self._main_directions(weighted, min(LATENT, len(counts)))
        self.vectors = self._unit(weighted @ self.base)
        self.labels = np.array(labels, dtype=np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    @staticmethod
    def _main_directions(rows: np.ndarray, wanted: int) -> np.ndarray:
        """Right singular vectors by subspace iteration from a fixed start."""
        start = np.random.default_rng(7).standard_normal((rows.shape[1], wanted + 8))
        basis = np.linalg.qr(start.astype(np.float32))[0]
        for _ in range(5):
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
        return (basis @ turn.T[:, :wanted]).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.ready:
            return np.full(len(texts), 0.5 if self.share is None else self.share)
        counts = np.stack(
            [term_counts((t or "").encode("utf-8", "surrogatepass"), self.terms) for t in texts]
        )
        near = self._unit(self._weighted(counts) @ self.base) @ self.vectors.T
        top = nearest(near, min(NEIGHBOURS, near.shape[1]))
        weight = np.maximum(np.take_along_axis(near, top, 1).astype(float), 0.0) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.labels[top]).sum(axis=1)
        score = np.divide(vote, total, out=np.full(len(texts), self.share), where=total > 1e-9)
        return np.clip(score, 0.0, 1.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_label: int = SAMPLE_ROWS,
) -> Model:
    """Fit on about ``rows_per_label`` documents of each label."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = counted.get(1, 0) / sum(counted.values()) if counted else None
    chosen = sample_by_label(
        usable.distinct().withColumn("text", F.lit("")), "id", "text", "label", rows_per_label, ("id",)
    ).drop("text")

    @F.arrow_udf("binary")
    def counted_terms(values: pa.Array) -> pa.Array:
        return pa.array(
            [packed(term_counts(t.as_py().encode("utf-8", "surrogatepass"), TERMS)) for t in values], pa.binary()
        )

    # a row per id and label, of bounded size: repeated ids and long texts stay in their tasks
    found = (
        texts.join(F.broadcast(chosen), "id")
        .where(F.col("text").isNotNull())
        .select("id", F.col("label").cast("int").alias("label"), counted_terms("text").alias("counts"))
        .groupBy("id", "label")
        .agg(F.min("counts").alias("counts"))
        .orderBy("id", "label")
        .collect()
    )
    counts = np.stack([unpacked_counts(r["counts"], TERMS) for r in found]) if found else np.empty((0, TERMS))
    return Model(counts, [r["label"] for r in found], share)


def score(docs: DataFrame, model: Model, text: Column, score_out: str) -> DataFrame:
    """Add the score, 0 to 1, higher for likelier good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def runs(texts: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            yield sent.value.scores(texts.slice(at, TEXTS_AT_ONCE).to_pylist())

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *runs(texts)]), pa.float64())

    kept = [c for c in docs.columns if c != score_out]
    found = docs.select(whole_row(docs), scored(text).alias("scored"))
    return unpacked(found, kept, **{score_out: F.col("scored")})
