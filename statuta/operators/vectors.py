"""Vector tables: pooling, checks, storage."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.scores import unit


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of one key and vector length; the last of a batch waits for the next one."""
    held = kind = None
    for batch in batches:
        kind = batch.schema.field("key").type
        lists = batch.column("v")
        lists = lists.fill_null([]) if lists.null_count else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        values = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
        counts = batch.column("n").to_numpy()
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        keys = batch.column("key").dictionary_encode()
        code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero((np.diff(code, prepend=-2) != 0) | (np.diff(sizes, prepend=-1) != 0)) if len(code) else code
        done: list[tuple] = []
        for a, b in zip(runs, np.append(runs[1:], len(code))):
            key, n = keys[int(a)].as_py(), int(counts[a:b].sum())
            total = values[cuts[a] : cuts[b]].reshape(b - a, -1).sum(0) if sizes[a] else np.zeros(0)
            if held and held[0] == key and len(held[1]) == len(total):
                held = (key, held[1] + total, held[2] + n)
            else:
                done += [held] if held else []
                held = (key, total, n)
        if done:
            yield _rows(done, kind)
    if held:
        yield _rows([held], kind)


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, totals, counts = zip(*done)
    return pa.record_batch([pa.array(keys, kind), pa.array([list(t) for t in totals], pa.list_(pa.float64())), pa.array(counts, pa.int64())], ["key", "v", "n"])


def mean_pool(parts: DataFrame) -> DataFrame:
    """``parts(key, embedding)`` to one vector per key: the unit mean; a single part stays as it is.

    Whole vectors are added up in the tasks that read them, then once more where the sums of a key meet; a key with very many
    parts is never gathered, and no row is made for a position. Vectors of a key must be of one length.
    """
    rows = parts.select("key", F.col("embedding").cast("array<double>").alias("v"), F.lit(1).cast("long").alias("n"))
    schema = f"key {parts.schema['key'].dataType.simpleString()}, v array<double>, n long"
    local = rows.sortWithinPartitions("key").mapInArrow(_sums, schema)
    whole = local.repartition("key").sortWithinPartitions("key").mapInArrow(_sums, schema)
    mean = F.transform("v", lambda x: x / F.col("n"))
    return whole.select("key", F.when(F.col("n") > 1, unit(mean)).otherwise(mean).alias("embedding"))


def vector_checks(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """One row: count, smallest and largest size, and whether the store may be written."""
    n_chunks = chunks.agg(F.count("*")).scalar()
    out = vectors.agg(
        F.count("*").alias("n_vectors"), F.min(F.size("embedding")).cast("long").alias("min_dim"), F.max(F.size("embedding")).cast("long").alias("max_dim")
    ).withColumn("n_chunks", n_chunks)
    ok = (F.col("min_dim") == dim) & (F.col("max_dim") == dim) & (F.col("n_vectors") == F.col("n_chunks"))
    return out.withColumn("valid", ok)


def write_vectors(vectors: DataFrame, chunks: DataFrame, path: str, dim: int) -> DataFrame:
    """Write the vectors when the checks hold, and give them back as read."""
    if not vector_checks(vectors, chunks, dim).first()["valid"]:
        raise ValueError("vectors do not fit the chunks or the expected dimension")
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.schema(vectors.schema).parquet(path)
