"""A quality score by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents gives the space (weighted term counts, truncated SVD) and the
labelled vectors. Both are small by their parameters and are broadcast. Every document is projected in
the tasks that read it, its cosines to all labelled vectors are one matrix product for
each block, and the labels of its nearest are averaged by similarity.

Terms are hashed word shapes, not words: letter case, punctuation and symbols around words, word
length, repeats of the word or the line before; those tell kinds of text apart in any language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, flat, mix, pieces, repeats

#: Labelled documents that are fitted, at most; latent dimensions; hashed terms; neighbours that vote.
SAMPLE, DIMENSIONS, TERMS, NEIGHBOURS = 4096, 32, 2048, 25
BLOCK = 512

#: Classes of bytes in a word's shape: lower, upper, digit, beyond ASCII, and each mark for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1
_CODE = mix(np.arange(256, dtype=U64) + U64(99))


def term_counts(batch: pa.RecordBatch):
    """Blocks of rows: dense counts of hashed terms, float32."""
    text, offsets = flat(batch["text"])
    for first, last in pieces(offsets):
        w = Words(text, offsets, first, last)
        n, doc = w.n_docs, w.doc
        # a word's shape: its bytes' classes, runs as one
        kind = _CLASS[w.data]
        turn = np.r_[True, kind[1:] != kind[:-1]]
        values = np.where(turn, _CODE[kind], U64(0))
        if len(w.start):
            values[w.start] = _CODE[kind[w.start]]
        # the sum of a run's classes, whatever its lengths
        total = np.r_[U64(0), np.cumsum(values, dtype=U64)]
        shape = mix(total[w.end] - total[w.start])
        length = np.minimum(w.end - w.start, 15).astype(U64)
        same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])] if len(w.start) else np.zeros(0, bool)
        again = repeats(doc, w.hash)[0] if len(w.start) else same
        line_doc, line_hash = w.lines()
        line_again = repeats(line_doc, line_hash)[0]
        terms = [shape, mix(length + U64(1000)), w.hash, np.where(same, U64(11), U64(12)), np.where(again, U64(13), U64(14))]
        terms = [mix(t + U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(TERMS // 2) + U64(TERMS // 2 * (k == 2)) for k, t in enumerate(terms)]
        lines = mix(np.where(line_again, U64(21), U64(22))) % U64(TERMS // 2)
        places = [doc * TERMS + t.astype(np.int64) for t in terms] + [line_doc * TERMS + lines.astype(np.int64)]
        yield np.bincount(np.concatenate(places), minlength=n * TERMS).astype(np.float32).reshape(n, TERMS)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, unit length
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = _weighted(counts, self.weights) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; without features or neighbours, the share of all."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.vectors))
        near = _nearest(cosines, k)
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0) ** 8
        total = votes.sum(axis=1)
        share = (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((total > 1e-9) & (counts.sum(axis=1) > 0), np.clip(share, 0, 1), self.prior)


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest; of equals at the end those of the smaller place."""
    if k == cosines.shape[1]:
        return np.broadcast_to(np.arange(k), cosines.shape)
    last = np.partition(cosines, -k, axis=1)[:, -k, None]
    above, level = cosines > last, cosines == last
    room = k - above.sum(axis=1, keepdims=True)
    take = above | level & (np.cumsum(level, axis=1) <= room)
    return np.nonzero(take)[1].reshape(-1, k)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.zeros_like(counts)
    row, term = np.nonzero(counts)
    total = np.maximum(counts.sum(axis=1), 1)
    x[row, term] = np.log1p(1000 * counts[row, term] / total[row]) * weights[term]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Inverse document frequencies, then a randomised SVD of the weighted counts."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = _weighted(counts, weights)
    k = min(DIMENSIONS, *x.shape)
    probe = np.random.default_rng(1).standard_normal((TERMS, k + 8)).astype(np.float32)
    q = np.linalg.qr(x @ probe)[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
    model = Model(weights, basis, np.zeros((0, k), np.float32), labels, prior)
    return Model(weights, basis, model.project(counts).astype(np.float32), labels.astype(np.float32), prior)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=None) -> DataFrame:
    """doc_id, held_out and score (0 to 1, higher: label 1 likelier) of each row of docs.

    held_out: a condition on doc_id; its rows are never fitted. At most SAMPLE labelled
    documents are (those of the smallest id hashes, so the choice does not
    hang on files or order). Null and empty texts get the share of label 1. Labels other than 0
    and 1, nulls, and labels of ids that docs lacks are left out; an id with two labels counts with each, and a labelled
    id with several texts with that of the smallest hash. Of equal cosines at the last neighbour those fitted first (by id) vote. Texts of any length
    are scored whole. Repeated rows and null ids are scored each. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0 if held_out is None else held_out
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out)
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)

    def counted(batches):
        for batch in batches:
            rows = np.concatenate(list(term_counts(batch)) or [np.zeros((0, TERMS), np.float32)])
            packed = [(np.flatnonzero(r).astype(np.int32), r[r > 0]) for r in rows]
            yield pa.record_batch([batch["label"], pa.array([i for i, _ in packed], pa.list_(pa.int32())), pa.array([v for _, v in packed], pa.list_(pa.float32()))], names=["label", "at", "n"])

    # the sample is bounded by SAMPLE rows, so it is broadcast and its counts are collected
    sample = thin.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id", "label").select("label", "text")
    rows = sample.mapInArrow(counted, "label int, at array<int>, n array<float>").collect()
    counts = np.zeros((len(rows), TERMS), np.float32)
    for x, r in zip(counts, rows, strict=True):
        x[r["at"]] = r["n"]
    sent = spark.sparkContext.broadcast(fit(counts, np.array([r.label for r in rows], np.float32)))

    def scored(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                score = np.concatenate([sent.value.score(c) for c in term_counts(part)] or [np.zeros(0)])
                yield pa.record_batch([part["doc_id"], pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    return thin.mapInArrow(scored, "doc_id long, score double").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
