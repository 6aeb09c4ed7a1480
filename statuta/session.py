"""Session helpers: local session for tests, and shared scratch space for long lineages."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "statuta.scratch.dir"


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("statuta")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.conf.get(SCRATCH, None):
        # one machine: its temporary folder is shared by all tasks
        spark.conf.set(SCRATCH, tempfile.mkdtemp(prefix="statuta-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    It is named by ``spark.checkpoint.dir``, or by ``statuta.scratch.dir`` where a session has no such setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if not folder:
        raise RuntimeError(f"Intermediate tables need a folder that all executors share: set spark.checkpoint.dir, or {SCRATCH} at run time.")
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The written table survives a lost executor, unlike a cached block.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
