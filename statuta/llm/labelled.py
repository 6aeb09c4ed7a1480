"""Labelled rows to learn from, and applying a fitted model to a table of texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.words import slices


def remainder(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string")) % parts


def labelled(labels: DataFrame, label: str, size: int, parts: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """At most ``size`` rows (key, label) that are not held out, the same rows in every run.

    Rows with a null key or a label other than 0 or 1 are left out; of several labels of a key the larger one counts.
    """
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("label").isin(0, 1) & (remainder(key, parts) != held_out))
    rows = rows.groupBy(key).agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64(key), key).limit(size)


def scored(docs: DataFrame, fn: Callable[[pa.Array], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; ``fn`` gives the scores of an array of texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array(fn(part.column("text")), pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def kept(docs: DataFrame, fn: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, where ``fn`` is true of the text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(fn(part.column(text)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
