"""Line files: JSON lines with a count of malformed ones, metrics and evaluation exports, logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_COLUMNS = [
    "query_id", "query", "gating_decision", "tier", "citation_hit", "citation_precision", "citation_recall",
    "citation_f1", "abstain", "latency_llm_ms", "latency_total_ms", "error",
]


def parsed_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """``lines`` with struct ``row`` and ``is_bad``; blank lines are dropped."""
    kept = lines.filter(F.trim(column) != "")
    row = F.from_json(F.trim(column), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return kept.withColumn("row", row).withColumn("is_bad", F.col("row._bad").isNotNull())


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with n_malformed)."""
    parsed = parsed_lines(spark.read.text(path), schema)
    names = spark.createDataFrame([], schema).columns
    good = parsed.filter("NOT is_bad").select(*[F.col(f"row.{n}").alias(n) for n in names])
    return good, parsed.agg(F.count_if("is_bad").alias("n_malformed"))


def metrics_long(metrics: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
    """(metric, value, extra...) rows of wide metrics."""
    return metrics.select(*extra, *names).unpivot(extra, names, "metric", "value")


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Write with a header and give back what was written."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def export_eval(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Fixed columns as CSV, full rows as JSON lines; both as read back."""
    csv = write_csv(rows.select(*EVAL_COLUMNS), f"{path}/metrics")
    rows.write.mode("overwrite").json(f"{path}/rows")
    return csv, rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Only the known columns; rows written before a column existed have null there."""
    return spark.read.schema(schema).parquet(path)


def file_registry(files: DataFrame, limit: int) -> DataFrame:
    """``files(path, length, content)`` with sha256, doc_id and status; the size limit depends on the entry point."""
    sha = F.sha2("content", 256)
    status = (
        F.when(F.col("content").isNull(), F.lit("missing"))
        .when(~F.lower("path").endswith(".pdf"), F.lit("not_pdf"))
        .when(F.col("length") == 0, F.lit("empty"))
        .when(F.col("length") > limit, F.lit("too_large"))
        .otherwise(F.lit("accepted"))
    )
    return files.select(
        "path", "length", sha.alias("sha256"), F.concat(F.lit("doc_"), F.substring(sha, 1, 16)).alias("doc_id"), status.alias("status")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def chat_store(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed users, conversations and messages; a role outside the three known ones is an error."""
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise(
        F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null"))))
    )
    return (
        users.select(F.col("user_id").cast("long"), "name"),
        conversations.select(F.col("conv_id").cast("long"), F.col("user_id").cast("long"), "title"),
        messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.col("text").alias("content")),
    )


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table read in ``parts`` ranges of its numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
