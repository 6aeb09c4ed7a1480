"""Language identification with string kernels.

A text is the set of its n-grams of 1 to 4 bytes (a blended spectrum, presence only) over lower-cased words, each hashed to one of
``1 << BITS`` columns. The kernel of two texts is the size of the common set over the geometric mean of both sizes. Nyström
landmarks span a small feature space, in which one ridge regression a language (one against the rest) is solved in closed form.
Texts are scored by products of presence blocks with the landmark block, and of kernel blocks with the weights.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text when nothing could be learned; ties
between languages go to the first by name; equal texts get equal answers; texts are read whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statuta.llm.labelled import remainder
from statuta.llm.words import WORD_SEPARATORS, lowered, pieces, slices

#: Rows to learn from, and landmarks, of each language at most.
PER_LANGUAGE = 200
LANDMARKS = 16
GRAMS = (1, 2, 3, 4)
BITS = 14
RIDGE = 1e-3
SHARPNESS = 4.0
#: Texts in one presence block at most.
BLOCK = 256


def columns(texts: pa.Array):
    """Pairs of arrays: a column of the presence matrix, and the number of the text."""
    shift = np.uint64(64 - BITS)
    for piece, text in pieces(lowered(texts), WORD_SEPARATORS):
        if not len(text):
            continue
        for n in GRAMS:
            at, grams = piece.grams(n)
            word = np.searchsorted(piece.starts, at + 1, "right") - 1
            yield ((grams * np.uint64(2 * n + 1)) >> shift).astype(np.int32), text[np.maximum(word, 0)]


def presence(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for column, text in columns(texts):
        out[text, column] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    #: Presence of the landmarks, each divided by the root of its size, and weights from their kernel values to each language.
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, block: np.ndarray) -> np.ndarray:
        return (block @ self.landmarks.T) / np.sqrt(np.maximum(block.sum(1, keepdims=True), 1))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language of each text, and its share of a softmax over all."""
        best, share = [], []
        for at in range(0, len(texts), BLOCK):
            margin = self.kernel(presence(texts.slice(at, BLOCK))).astype(np.float64) @ self.weights + self.bias
            e = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
            best.append(margin.argmax(1))
            share.append(e.max(1) / e.sum(1))
        return np.concatenate([np.zeros(0, np.int64), *best]), np.concatenate([np.zeros(0), *share])


def solve(languages: list[str], of: np.ndarray, rows: list[np.ndarray]) -> Model:
    """``rows``: the columns present in each training text; ``of``: the number of its language."""
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    chosen = np.concatenate([np.flatnonzero(of == k)[:LANDMARKS] for k in range(len(languages))])
    model = Model(languages, x[chosen] / np.sqrt(np.maximum(x[chosen].sum(1, keepdims=True), 1)), np.zeros(0), np.zeros(0))
    k = model.kernel(x).astype(np.float64)
    value, vector = np.linalg.eigh(k[chosen])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    feature = k @ root
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # languages weigh alike however many rows each has
    weight = (len(of) / (len(languages) * np.bincount(of, minlength=len(languages))))[of][:, None]
    centre = (weight * feature).sum(0) / weight.sum()
    middle = (weight * target).sum(0) / weight.sum()
    z = feature - centre
    w = np.linalg.solve(z.T @ (weight * z) + RIDGE * len(of) * np.eye(z.shape[1]), z.T @ (weight * (target - middle)))
    model.weights, model.bias = root @ w, middle - centre @ w
    return model


def fit(docs: DataFrame, parts: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from at most ``per_language`` rows of each language whose key's crc32 modulo ``parts`` is not ``held_out``.

    Only the columns present in the sample reach the driver.
    """
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", parts) != held_out)).withColumn("order", F.xxhash64("doc_id"))
    # one row a language; a share of the hashes leaves about twice what is wanted, however many rows a language has
    share = F.broadcast(rows.groupBy("lang").agg((F.lit(2.0 * (1 << 40) * per_language) / F.count("*")).cast("long").alias("below")))
    few = rows.join(share, "lang").filter((F.pmod("order", F.lit(1 << 40)) < F.col("below")) & F.col("text").rlike(r"\p{L}"))
    few = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("order", "doc_id", "text"))).filter(F.col("n") <= per_language)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [text.astype(np.int64) << BITS | column for column, text in columns(part.column("text"))]
                both = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
                cuts = np.searchsorted(both, np.arange(part.num_rows + 1) << BITS).astype(np.int32)
                ids = pa.ListArray.from_arrays(cuts, pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.record_batch([part.column("lang"), part.column("n"), ids], ["lang", "n", "ids"])

    table = few.select("lang", "n", "text").mapInArrow(run, "lang string, n int, ids array<int>").toArrow().to_pandas().sort_values(["lang", "n"])
    if not len(table):
        return None
    languages = sorted(table.lang.unique())
    return solve(languages, np.array([languages.index(x) for x in table.lang]), [np.asarray(x, np.int64) for x in table.ids])


UNKNOWN = "und"


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                best, share = model.predict(part.column("text")) if model else (np.zeros(len(letters), int), np.zeros(len(letters)))
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)] if model else [UNKNOWN] * len(letters)
                yield pa.record_batch([part.column("key"), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))], ["key", "lang_pred", "score"])

    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
