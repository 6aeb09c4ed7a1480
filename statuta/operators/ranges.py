"""Global order without a global task: rows are sorted in ranges, ranges are shifted by what lies before them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.session import stored


def prefix_sum(df: DataFrame, key: str, weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows of smaller ``key``; keys are unique.

    The ranged rows are written with their range number, as a range is only the same
    range when it is computed once.
    """
    ranged = stored(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    # one row per range, as many as shuffle partitions: one window over them is small
    shift = sizes.select(
        "_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before")
    )
    local = F.sum(weight).over(W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, 0)) - F.col(weight)
    out = ranged.withColumn("_local", local).join(F.broadcast(shift), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def numbered(df: DataFrame, key: str, start: int = 0, name: str = "chunk_id") -> DataFrame:
    """Consecutive numbers from ``start`` in order of the unique ``key``."""
    out = prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", name).drop("_one")
    return out.withColumn(name, F.col(name) + start)
