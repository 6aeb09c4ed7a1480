"""Retrieval queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions.text import collapsed
from statuta.operators import retrieval as R
from statuta.plans import inputs as I
from statuta.plans.registry import query

_RANKED = "SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score"


def shown(df):
    return df.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("term_stats", f"""WITH {I.BM25}, w AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)
SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf,
  CAST(n AS BIGINT) AS n_chunks, round(avgdl, 6) AS mean_length FROM w, corpus""")
def term_stats(spark, d):
    chunks = I.chunks(spark, d)
    n, df = F.col("s.n"), F.col("df")
    return R.term_stats(chunks).withColumn("s", R.corpus_size(chunks)).select(
        "term", "df", "cf", F.round(F.log(1 + (n - df + 0.5) / (df + 0.5)), 6).alias("idf"),
        n.alias("n_chunks"), F.round("s.avgdl", 6).alias("mean_length"),
    )


@query("bm25_topk", f"WITH {I.BM25} {_RANKED} FROM bm25 WHERE rank <= 100")
def bm25_topk(spark, d):
    return shown(R.bm25_topk(I.chunks(spark, d), I.queries(spark, d), 100))


@query("tfidf_topk", f"WITH {I.TFIDF} {_RANKED} FROM tfidf WHERE rank <= 10")
def tfidf_topk(spark, d):
    return shown(R.tfidf_topk(I.chunks(spark, d), I.queries(spark, d), 10))


@query("dense_topk", f"WITH {I.DENSE} {_RANKED} FROM dense WHERE rank <= 100")
def dense_topk(spark, d):
    return shown(R.dense_topk(I.chunk_vectors(spark, d), I.query_vectors(spark, d), 100))


@query("rrf_merge", f"WITH {I.BM25}, {I.DENSE}, {I.sql_rrf(50)} {_RANKED} FROM rrf")
def rrf_merge(spark, d):
    keyword = R.bm25_topk(I.chunks(spark, d), I.queries(spark, d), 50)
    dense = R.dense_topk(I.chunk_vectors(spark, d), I.query_vectors(spark, d), 50)
    return shown(R.rrf_merge([keyword, dense]))
