"""Text quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import blocks, documents, null_ids

BITS = 18
#: Labelled documents that are learned from, those of the smallest hash; the model is bounded, not the scoring.
SAMPLE = 15_000
BLOCK = 1024 * 1024
EPOCHS = 4
SCALE = 5.0
# Follow-the-regularised-leader: step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0, 0.05

#: Bytes by kind: small letters (and all beyond ASCII) are x, large ones X, digits 9, marks themselves.
SHAPE = np.arange(256, dtype="u1")
SHAPE[97:123] = SHAPE[128:] = ord("x")
SHAPE[65:91] = ord("X")
SHAPE[48:58] = ord("9")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of every word place: ``row, feature, weight``.

    N-grams of one and two words, and of one to three word shapes (kinds of characters with
    runs cut to one, and whether the word repeats the one before). A feature weighs ``SCALE``
    parts in the number of its row's words.
    """
    words = W.split(texts)
    n = len(words.start)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    kinds = SHAPE[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | W.SEPARATOR[kinds[1:]]
    keep[words.start] = True
    offsets = np.append(0, np.cumsum(keep))[words.offsets]
    shapes = W.split_bytes(kinds[keep], offsets).hash
    same = np.zeros(n, bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    shapes = np.where(same, ~shapes, shapes)
    share = (SCALE / np.maximum(1, np.diff(words.first)))[row]
    rows, found, weight = [], [], []
    for salt, (values, size) in enumerate(((words.hash, 1), (words.hash, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        hashed = W.rolling(values, size) + np.uint64(salt * 0xA24BAED4963EE407 % 2**64)
        whole = row[: len(hashed)] == row[size - 1 :]
        rows.append(row[: len(hashed)][whole])
        found.append((W.mix(hashed[whole]) >> np.uint64(64 - BITS)).astype("i8"))
        weight.append(share[: len(hashed)][whole])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(weight)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """Per-coordinate FTRL; the last weight is the constant's."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ values) - label) * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id may be."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents that are not held out.

    A document labelled both ways counts as 0, one without text as empty; null labels are left
    out. Without any label all weights are 0. The sample is broadcast to the scan of the texts
    (16 bytes a row) and learned from in one task: both are bounded by ``sample``.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    chosen = one.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("place", "label", "text")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = Leader(), []
        for frame in frames:
            row, found, weight = features(pa.array(frame["text"], pa.string()))
            order = np.argsort(row, kind="stable")
            row, found, weight = row[order], found[order], weight[order]
            ends = np.searchsorted(row, np.arange(len(frame) + 1))
            for i, (place, label) in enumerate(zip(frame["place"], frame["label"])):
                at, which = np.unique(found[ends[i] : ends[i + 1]], return_inverse=True)
                values = np.bincount(which, weight[ends[i] : ends[i + 1]], len(at))
                known.append((place, np.append(at, 2**BITS).astype("i4"), np.append(values, 1).astype("f4"), label))
        known.sort(key=lambda x: (x[0], x[3], len(x[1])))
        for _ in range(EPOCHS):
            for _, at, values, label in known:
                model.learn(at, values.astype("f8"), label)
        yield pd.DataFrame({"weights": [model.weights(slice(None)).astype("f4").tobytes()]})

    found = rows.repartition(1).mapInPandas(learn, "weights binary").first()
    if found is None:
        return np.zeros(2**BITS + 1)
    return np.frombuffer(found["weights"], "f4").astype("f8")


def _scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    row, found, weight = features(batch.column("text").fill_null(""))
    return sigmoid(np.bincount(row, weights[found] * weight, batch.num_rows) + weights[-1])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; an empty text has the constant alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, weights))], ["doc_id", "score"])

    scored = null_ids(documents(docs).mapInArrow(run, "doc_id long, score double"), "doc_id")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted to be good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield batch.filter(pa.array(_scores(batch, weights) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
