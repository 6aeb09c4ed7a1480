"""Nested documents and stored chunk metadata."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.chunking import NESTED


def nested_documents(spark: SparkSession, path: str, multi_line: bool = True, schema: str = NESTED) -> DataFrame:
    """Nested documents with their source path; undecodable ones are skipped.

    ``path`` may be a glob; ``multi_line`` reads one document per file, else one per line.
    """
    raw = (
        spark.read.schema(schema + ", _bad string")
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    return raw.withColumn("path", F.col("_metadata.file_path")).filter(F.col("_bad").isNull()).drop("_bad")


def _either(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


CHUNK_RECORD = (
    "chunk_id bigint, faiss_id bigint, text string, passage string, score_retrieval double, faiss_score double, "
    "score_rerank double, rerank_score double, "
    "metadata struct<van_ban:string,chuong:string,dieu:string,khoan:string,diem:string,source_file:string,page_number:int>, "
    "meta struct<van_ban:string,chuong:string,dieu:string,khoan:string,diem:string,source_file:string,page_number:int>"
)


def chunk_records(records: DataFrame) -> DataFrame:
    """Records of CHUNK_RECORD shape to one typed row each: aliases resolved, defaults applied."""
    meta = F.coalesce("metadata", "meta")
    return records.select(
        F.coalesce(_either("chunk_id", "faiss_id"), F.lit(-1)).alias("chunk_id"),
        F.coalesce(_either("text", "passage"), F.lit("")).alias("text"),
        F.coalesce(_either("score_retrieval", "faiss_score"), F.lit(0.0)).alias("score_retrieval"),
        F.coalesce(_either("score_rerank", "rerank_score"), F.lit(0.0)).alias("score_rerank"),
        F.coalesce(meta["van_ban"], F.lit("")).alias("van_ban"),
        *[meta[f].alias(f) for f in ("chuong", "dieu", "khoan", "diem")],
        F.coalesce(meta["source_file"], F.lit("")).alias("source_file"),
        meta["page_number"].alias("page_number"),
    )


def reranked_rows(records: DataFrame) -> DataFrame:
    """(id, rank, chunk_id, text, score_rerank, van_ban, dieu, khoan, diem) from the nested top-five arrays."""
    return records.select("id", F.posexplode("top5_reranked").alias("pos", "r")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.coalesce("r.chunk_index", F.lit(-1)).alias("chunk_id"),
        F.coalesce("r.passage", F.lit("")).alias("text"), F.coalesce(F.col("r.ce_score"), F.lit(0.0)).alias("score_rerank"),
        F.coalesce("r.van_ban", F.lit("")).alias("van_ban"), *[F.col(f"r.{f}").cast("string").alias(f) for f in ("dieu", "khoan", "diem")],
    )
