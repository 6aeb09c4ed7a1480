"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram inside a word, and every immediate repetition of a word has a learned vector, found by
hash. A text is the mean of its vectors; a softmax layer gives the probability of label 1. Vectors and layer are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows.

Defined cases: a null or empty text has no features, so its score is that of the bias alone; without any labelled row the
score is 0.5; equal texts get equal scores; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm import labelled
from statuta.llm.words import SPACE_SEPARATORS, pieces, slices

#: Labelled rows to train on at most.
SAMPLE = 4000
BITS = 15
DIMENSIONS = 16
GRAMS = (3, 5)
#: Passes over the sample, and steps at least (a small sample is passed more often).
EPOCHS = 6
STEPS = 750
BATCH = 32
RATE = 2.0


@dataclass
class Model:
    """``weight``: what a feature adds to the log-odds of label 1, its vector times the layer's difference."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of label 1.

        The mean of vectors times a layer is the mean of the products, so products are summed.
        """
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, text in features(texts):
            total += np.bincount(text, self.weight[bucket], len(texts))
            count += np.bincount(text, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def features(texts: pa.Array):
    """Pairs of arrays: hashed features, and the number of the text that each lies in."""
    shift = np.uint64(64 - BITS)
    last_text, last_word = -1, None
    for piece, text in pieces(texts, SPACE_SEPARATORS):
        if not len(text):
            continue
        words = piece.words()
        yield (words >> shift).astype(np.int64), text
        same = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) + 1
        if last_text == text[0] and last_word == words[0]:  # a long text goes on
            same = np.append(same, 0)
        yield np.zeros(len(same), np.int64), text[same]
        last_text, last_word = text[-1], words[-1]
        for n in GRAMS:
            at, grams = piece.grams(n)
            # a range may begin with the separator before its word
            word = np.searchsorted(piece.starts, at + 1, "right") - 1
            yield ((grams * np.uint64(2 * n + 1)) >> shift).astype(np.int64), text[word]


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, label, ids, counts): distinct features as 16-bit numbers, and their counts as 32-bit ones, of the given rows (doc_id, label, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [(text << BITS) + bucket for bucket, text in features(part.column("text"))]
                both, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                cuts = np.searchsorted(both, np.arange(part.num_rows + 1) << BITS)
                ids, counts = (both & ((1 << BITS) - 1)).astype(np.uint16), counts.astype(np.float32)
                packed = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (ids, counts)]
                yield pa.record_batch([part.column("doc_id"), part.column("label"), *packed], ["doc_id", "label", "ids", "counts"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, ids binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows whose key's crc32 modulo ``parts`` is not ``held_out``.

    Only the sample's feature counts reach the driver.
    """
    chosen = labelled.labelled(labels, label, sample, parts, held_out)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # one row a sampled key, however many rows have it
    one = counted(rows).groupBy("doc_id", "label").agg(F.min(F.struct("ids", "counts")).alias("r")).select("doc_id", "label", "r.ids", "r.counts")
    table = one.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])  # the same order however the rows arrived
    ids, counts = ([np.frombuffer(x.as_buffer(), kind) for x in table[c]] for c, kind in (("ids", np.uint16), ("counts", np.float32)))
    model = train(ids, counts, table["label"].to_numpy())
    # the driver holds no more than the weights from here on
    del table, ids, counts
    pa.default_memory_pool().release_unused()
    return model


def train(ids: list, counts: list, label: np.ndarray, seed: int = 1) -> Model:
    """Vectors of all hashed features and a softmax layer of two outputs."""
    random = np.random.default_rng(seed)
    size, n = 1 << BITS, len(ids)
    if not n:
        return Model(np.zeros(size), 0.0)
    label = np.asarray(label)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    layer[0, 1], layer[0, 0] = 0.1, -0.1
    per_epoch = -(-n // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        shuffled = random.permutation(n)
        for at in range(0, n, BATCH):
            rows = shuffled[at : at + BATCH]
            x = np.zeros((len(rows), size), np.float32)
            for k, i in enumerate(rows):
                x[k, ids[i]] = counts[i] / max(1.0, counts[i].sum())
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = x @ vectors
            out = hidden @ layer + bias
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
            out[np.arange(len(rows)), label[rows]] -= 1
            out /= len(rows)
            below = out @ layer.T
            layer -= rate * hidden.T @ out
            bias -= rate * out.sum(0)
            # a feature seldom seen still has to learn: its step grows with the rarity that the mean gives it
            vectors -= (rate * DIMENSIONS) * (x.T @ below)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


#: Score from which a document is kept.
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = labelled.scored(docs, fit(docs, labels).score)
    return out.select(
        "doc_id",
        F.coalesce(labelled.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, with all their columns."""
    model = fit(docs, labels)
    return labelled.kept(docs, lambda texts: model.score(texts) >= threshold)
