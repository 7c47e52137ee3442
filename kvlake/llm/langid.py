"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are runs of two and three bytes, ASCII letters in lower case, hashed into BUCKETS. Spark tasks count them; numpy on the driver
learns the embeddings and the softmax by stochastic gradient descent from a bounded sample of rows (SAMPLE_ROWS, the only bound here);
Spark tasks then average the embeddings over each whole text. A temperature, and the least score at which a prediction is accepted,
come from a part of the sample that is set aside.

A text that is null or has no letter gets `und`, score 0 and rejected = true. Nulls in other columns are not looked at, rows without a
language are not learned from, repeated rows are predicted one by one (and learned from once for each id), and an empty table gives an
empty result. Where no row can be learned from, all is `und`. Languages that tie go by their names. A very long text is worked on as a
whole, with some ten arrays of its length in a task. Ids may be of any type that can be ordered; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm.sampling import bounded, held_out

#: Most rows that the model is learned from.
SAMPLE_ROWS = 4_000
BUCKETS = 4_096
DIMENSIONS = 16
#: Of the predictions accepted on the rows set aside, this share has to be right.
PRECISION = 0.99


def subwords(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in each document, as shares."""
    n = len(bounds) - 1
    low = A.LOWER[data].astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.zeros(n * BUCKETS)
    for k, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(low) < k:
            continue
        end = len(low) - k + 1
        code = np.zeros(end, dtype=np.int64)
        for i in range(k):
            code = (code << 8) | low[i : i + end]
        inside = doc[:end] == doc[k - 1 :]
        bucket = ((code * factor) >> 12) % BUCKETS
        counts += np.bincount((doc[:end] * BUCKETS + bucket)[inside], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = (x @ (self.embeddings @ self.weights) + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 2.0, batch: int = 32, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross entropy of rows of x; a fifth is set aside to calibrate."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, rows = order[: len(y) // 5], order[len(y) // 5 :]
    m = Model(languages, rng.normal(0, 1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, len(languages))), np.zeros(len(languages)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(rows)
        for i in range(0, len(rows), batch):
            xs, ys = x[rows[i : i + batch]], y[rows[i : i + batch]]
            hidden = xs @ m.embeddings
            logits = hidden @ m.weights + m.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ys)), ys] -= 1
            p /= len(ys)
            back = p @ m.weights.T
            m.weights -= step * hidden.T @ p
            m.bias -= step * p.sum(0)
            used = np.flatnonzero(xs.any(0))
            m.embeddings[used] -= step * 10 * xs[:, used].T @ back
    if len(aside):
        losses = []
        temperatures = np.geomspace(0.1, 10, 41)
        for m.temperature in temperatures:
            losses.append(-np.log(np.maximum(m.probabilities(x[aside])[np.arange(len(aside)), y[aside]], 1e-12)).mean())
        m.temperature = float(temperatures[int(np.argmin(losses))])
        p = m.probabilities(x[aside])
        top, right = p.max(1), p.argmax(1) == y[aside]
        by = np.argsort(-top, kind="stable")
        precision = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        m.accept = float(top[by][good[-1]]) if len(good) else 1.0
    return m


def train(docs: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model from at most `most` rows with a language, outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = bounded(known.select("doc_id").distinct(), "doc_id", most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                x = subwords(data, bounds)
                d, b = np.nonzero(x)
                offsets = pa.array(np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), batch["lang"].slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(b.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x[d, b].astype(np.float32)))],
                    ["doc_id", "lang", "bucket", "share"],
                )

    got = known.join(F.broadcast(ids), "doc_id").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, bucket array<int>, share array<float>").toPandas()
    got = got.sort_values(["doc_id", "lang"], kind="stable").drop_duplicates("doc_id")
    languages = sorted(got["lang"].unique())
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, (b, s) in enumerate(zip(got["bucket"], got["share"], strict=True)):
        x[i, b] = s
    return fit(x, np.searchsorted(languages, got["lang"].to_numpy(dtype=str)) if languages else np.zeros(0, int), languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, in one pass without a shuffle."""
    names = np.array(model.languages, dtype=object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                letters = batch["letters"].slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                lang, top = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                if len(names):
                    p = model.probabilities(subwords(data, bounds))
                    lang, top = np.where(letters, names[p.argmax(1)], "und"), np.where(letters, p.max(1), 0.0)
                rejected = ~letters | (top < model.accept) | (len(names) == 0)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(lang, pa.string()), pa.array(top), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rated = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = rated.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
