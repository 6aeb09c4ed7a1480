"""Sharding along a Hilbert curve.

Metadata columns are quantised to cells by their quantiles, a row's cells give its place on the curve, and the rows in curve order are
cut into runs of equal row counts. Neighbours on the curve are close in every column, so each run covers a small range of each. Cell
numbers are spread over the whole range, so a column of few values turns the curve as early as one of many. Strings are compared whole.

The law is ``rows``: with n rows, shard s holds the ranks from ceil(s*n/shards) on, so counts are at most one apart. Equal texts of one
cell lie next to each other (the checksum orders rows within a cell).

Defined cases: a null in a metadata column sorts before all values; a null text has no bytes and checksum 0; ties in all keys may stand
in either order, which gives the same rows; fewer rows than shards leave shards empty; an empty table gives an empty result; a column
given as metadata may have any name.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import stored

SHARDS = 40
BITS = 6
OVERHEAD = 16
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (rows x dimensions, each cell below ``1 << bits``).

    From the highest bit down, a set bit turns the lower bits of the first dimension over and a clear one swaps them with
    the first dimension's; Gray decoding over the dimensions gives the digits of the place.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(n):
            up = (x[:, i] & high) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[:, i] >> b) & 1)
    return place


def ordinal(docs: DataFrame, column: str) -> Column:
    """A long or a string in the order of the values."""
    kind, c = docs.schema[column].dataType, F.col(f"`{column}`")
    return c.try_cast("long") if isinstance(kind, (T.NumericType, T.BooleanType)) else c.cast("string")


def string_cuts(values: DataFrame, cells: int) -> tuple[list[bytes], bytes]:
    """Cuts between cells of whole strings, in byte order, and the greatest string: all strings where there are few, else quantiles."""
    counts = stored(values.filter("_value is not null").groupBy("_value").agg(F.count("*").alias("_n")), "values")
    few = [r["_value"].encode() for r in counts.select("_value").limit(cells + 1).collect()]
    if len(few) <= cells:
        return sorted(few), max(few, default=b"")
    ranged = stored(counts.repartitionByRange("_value").withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_rows"))  # one row a range
    before = parts.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(W.partitionBy()).alias("_total"))
    upto = ranged.withColumn("_inside", F.sum("_n").over(W.partitionBy("_part").orderBy("_value"))).join(F.broadcast(before), "_part").withColumn("_upto", F.expr("_before + _inside"))
    # the strings at which the running count reaches the next cell
    cuts = upto.filter(F.expr(f"_upto < _total and _upto * {cells} div _total > (_upto - _n) * {cells} div _total")).select("_value").collect()
    return sorted(r["_value"].encode() for r in cuts), ranged.agg(F.max("_value")).first()[0].encode()


def cell_numbers(values: pa.Array, cuts, greatest, bits: int = BITS) -> np.ndarray:
    """Cells spread from 0, which nulls have too, to the highest one, which the greatest value has."""
    out = np.zeros(len(values), np.int64)
    known = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        coded = values.drop_null().dictionary_encode()
        distinct = [x.encode() if isinstance(x, str) else x for x in coded.dictionary.to_pylist()]
        cell = np.array([bisect_left(cuts, x) for x in distinct], np.int64)
        out[known] = cell[coded.indices.to_numpy()]
    return out * ((1 << bits) - 1) // max(1, bisect_left(cuts, greatest))


def placed(docs: DataFrame, dimensions=DIMENSIONS, shards: int = SHARDS, bits: int = BITS, carry=(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, curve, shard, slot and the ``carry`` columns) of every row."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(content.cast("binary")).alias("_crc"),
        *[ordinal(docs, d).alias(f"_d{i}") for i, d in enumerate(dimensions)],
        F.struct(*[F.col(c) for c in carry], F.lit(0)).alias("_carry"),
    )
    names = [f"_d{i}" for i in range(len(dimensions))]
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [n for n in names if isinstance(rows.schema[n].dataType, T.LongType)]
    measures = [x for n in numbers for x in (F.percentile_approx(n, F.array(*map(F.lit, share)), 10_000).alias(n), F.max(n).alias(f"{n}_max"))]
    found = docs.select(*[ordinal(docs, d).alias(n) for n, d in zip(names, dimensions)]).agg(F.lit(0), *measures).first()
    cuts = [
        (sorted(set(found[n] or [])), found[f"{n}_max"] or 0) if n in numbers else string_cuts(docs.select(ordinal(docs, d).alias("_value")), 1 << bits)
        for n, d in zip(names, dimensions)
    ]

    def curve(batches):
        for batch in batches:
            cells = np.empty((batch.num_rows, len(cuts)), np.int64)
            for i, (cut, greatest) in enumerate(cuts):
                cells[:, i] = cell_numbers(batch.column(f"_d{i}"), cut, greatest, bits)
            yield pa.record_batch([*(batch.column(c) for c in ("_key", "_size", "_crc", "_carry")), pa.array(hilbert(cells, bits))], ["_key", "_size", "_crc", "_carry", "_curve"])

    kind = rows.schema["_carry"].dataType
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("_size", T.LongType()), T.StructField("_crc", T.LongType()), T.StructField("_carry", kind), T.StructField("_curve", T.LongType())])
    # written once: the ranges are sampled from it, and texts are not read again
    digests = stored(rows.mapInArrow(curve, schema), "digests")
    order = ["_curve", "_crc", "_key", "_size"]
    ranged = stored(digests.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "curve")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    ranked = ranged.withColumn("_inside", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1).join(F.broadcast(before), "_part")
    rank, total = F.col("_before") + F.col("_inside"), F.col("_total")
    ranked = ranked.withColumn("_rank", rank).withColumn("_shard", F.expr(f"_rank * {shards} div _total").cast("int"))
    return ranked.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_curve").alias("curve"),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - F.expr(f"(_shard * _total + {shards - 1}) div {shards}")).alias("slot"),
        *[F.col("_carry")[c].alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, **settings) -> None:
    """Files of whole rows in curve order under one folder a shard; a large shard is several files."""
    columns = docs.columns
    rows = placed(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])), carry=["_row"], **settings)
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "slot", "_row")
    rows.select("slot", F.struct("_row.*").alias("row"), "shard").write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame) -> DataFrame:
    """The placement under the law ``rows``."""
    return placed(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
