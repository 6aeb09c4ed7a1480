"""Queries over gold sets, metrics, sources, sinks and the stores."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.operators import context as X
from statuta.operators import decisions as D
from statuta.operators import evaluation as E
from statuta.operators import retrieval as R
from statuta.operators import store as ST
from statuta.operators import vectors as VE
from statuta.plans import decisions as DQ
from statuta.plans import inputs as I
from statuta.plans import matching as MQ
from statuta.plans import ranking as RQ
from statuta.plans import reports as PQ
from statuta.plans.inputs import lit, sql_tokens
from statuta.plans.registry import query
from statuta.session import shared_folder, stored
from statuta.sources import documents as SD
from statuta.sources import lines as SL
from statuta.sources.tables import table


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- gold sets --------------------------------------------------------------


def labelled(spark, d):
    """Documents as labelled pairs; every fourth has no label; queries repeat."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    key = F.col("doc_id")
    meta = F.struct(
        F.col("source").alias("van_ban"), F.lit("I").alias("chuong"), F.when(key % 3 > 0, F.col("lang")).alias("dieu"),
        (key % 7).cast("string").alias("khoan"), F.lit(None).cast("string").alias("diem"), F.when(key % 5 > 0, key).alias("chunk_index"),
    )
    return docs.select(
        key.alias("pos"), F.concat("lang", F.lit("-"), (key % 97).cast("string")).alias("query"), F.col("text").alias("passage"),
        F.col("quality").alias("label"), meta.alias("meta"),
    )


LABELLED = """lab AS (SELECT d.doc_id AS pos, lang || '-' || (d.doc_id % 97) AS query, text AS passage, quality AS label, source AS van_ban, CASE WHEN d.doc_id % 3 > 0 THEN lang END AS dieu, CAST(d.doc_id % 7 AS VARCHAR) AS khoan,
  CASE WHEN d.doc_id % 5 > 0 THEN d.doc_id ELSE -1 END AS chunk_index FROM documents d LEFT JOIN labels USING (doc_id))"""


def flat_citation(df, *columns):
    return df.withColumn("e", F.col("expected_citations")[0]).select("id", "query", "e.van_ban", "e.dieu", "e.khoan", "e.chunk_index", *columns)


@query("goldset_build", f"WITH {LABELLED} SELECT CASE WHEN pos < 1000 THEN 'eval_' || lpad(CAST(pos AS VARCHAR), 4, '0') ELSE 'eval_' || pos END AS id, query, van_ban, coalesce(dieu, '') AS dieu, khoan, chunk_index FROM lab WHERE coalesce(label, 1) = 1")
def goldset_build(spark, d):
    return flat_citation(E.goldset_build(labelled(spark, d)))


@query("goldset_dedup", f"WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS n FROM lab) SELECT 'dev_' || pos AS id, query, van_ban, dieu, khoan, chunk_index, passage AS expected_answer FROM r WHERE n = 1 AND label = 1")
def goldset_dedup(spark, d):
    return flat_citation(E.goldset_dedup(labelled(spark, d)), "expected_answer")


@query("goldset_alias_load", f"WITH {LABELLED} SELECT CASE WHEN pos % 2 = 0 THEN 'g' || pos ELSE 'q_' || pos END AS id, query, passage AS expected_answer, CASE WHEN label IS NULL THEN true ELSE label = 1 END AS is_answerable FROM lab")
def goldset_alias_load(spark, d):
    pos = F.col("pos")
    rows = labelled(spark, d).select(
        "pos", F.when(pos % 2 == 0, F.concat(F.lit("g"), pos.cast("string"))).alias("id"), F.when(pos % 3 == 0, F.col("query")).alias("query"),
        F.when(pos % 3 > 0, F.col("query")).alias("question"), F.col("passage").alias("expected_answer"), (F.col("label") == 1).alias("is_answerable"),
    )
    return E.goldset_load(rows)


# ---- metrics ----------------------------------------------------------------

HITS = f"{MQ.GOLD}, hits AS (SELECT r.query_id, r.chunk_id, r.rank, r.score, c.van_ban, c.dieu, {MQ.HIT} AS hit FROM run r JOIN chunks c USING (chunk_id))"
PER_QUERY = """best AS (SELECT query_id, min(rank) AS best FROM hits WHERE hit GROUP BY query_id),
pq AS (SELECT item_id AS query_id, CASE WHEN best <= 1 THEN 1 ELSE 0 END AS hit1, CASE WHEN best <= 3 THEN 1 ELSE 0 END AS hit3, CASE WHEN best <= 5 THEN 1 ELSE 0 END AS hit5, CASE WHEN best <= 5 THEN round(1.0::DOUBLE / best, 4) ELSE 0.0::DOUBLE END AS mrr FROM benchmark LEFT JOIN best ON best.query_id = item_id)"""
_RECALL = "count(*) AS n_queries, round(avg(hit1), 4) AS recall_at_1, round(avg(hit3), 4) AS recall_at_3, round(avg(hit5), 4) AS recall_at_5, round(avg(mrr), 4) AS mrr_at_5"


def hits(spark, d, run=None):
    return E.hit_join(MQ.run_rows(spark, d, run if run is not None else I.rrf_run(spark, d)), MQ.gold(spark, d))


def per_query(spark, d):
    return E.per_query_hits(I.queries(spark, d), hits(spark, d))


@query("recall_mrr", f"WITH {I.RRF_RUN}, {HITS}, {PER_QUERY} SELECT {_RECALL} FROM pq")
def recall_mrr(spark, d):
    return E.recall_mrr(per_query(spark, d))


@query("result_entry_export", f"""WITH {I.RRF_RUN}, {HITS}, {PER_QUERY}, t AS (SELECT query_id, string_agg(rank || ':' || chunk_id || ':' || hit || ':' || van_ban, ',' ORDER BY rank) AS top5 FROM hits WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, q.text AS query, hit1, hit3, hit5, mrr, top5 FROM pq JOIN t USING (query_id) JOIN benchmark q ON q.item_id = query_id""")
def result_entry_export(spark, d):
    entries = E.result_entries(I.queries(spark, d), hits(spark, d), per_query(spark, d))
    path = fresh(spark, "entries")
    entries.write.json(path)
    back = spark.read.schema(entries.schema).json(path)
    shown = F.transform("top5_reranked", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["chunk_index"].cast("string"), r["hit"].cast("string"), r["van_ban"]))
    return back.select("query_id", "query", "hit1", "hit3", "hit5", "mrr", F.array_join(shown, ",").alias("top5"))


@query("citation_prf", f"""WITH {MQ.CITED_PAIRS}, ex AS (SELECT * FROM e WHERE query_id % 7 > 0), m2 AS (SELECT query_id, count(DISTINCT out_no) AS mo, count(DISTINCT exp_no) AS me FROM mt WHERE query_id % 7 > 0 GROUP BY query_id),
no AS (SELECT query_id, count(*) AS no FROM o GROUP BY query_id), ne AS (SELECT query_id, count(*) AS ne FROM ex GROUP BY query_id),
x AS (SELECT o_orderkey AS query_id, coalesce(no, 0) AS no, coalesce(ne, 0) AS ne, coalesce(mo, 0) AS mo, coalesce(me, 0) AS me FROM orders LEFT JOIN no ON no.query_id = o_orderkey LEFT JOIN ne ON ne.query_id = o_orderkey LEFT JOIN m2 ON m2.query_id = o_orderkey),
y AS (SELECT *, CASE WHEN no = 0 THEN 0 ELSE mo / no::DOUBLE END AS p, CASE WHEN ne = 0 OR no = 0 THEN 0 ELSE me / ne::DOUBLE END AS r FROM x)
SELECT query_id, CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE round(p, 4) END AS precision, CASE WHEN ne = 0 THEN 1.0::DOUBLE ELSE round(r, 4) END AS recall, CASE WHEN ne = 0 THEN 1.0::DOUBLE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE round(2 * p * r / (p + r), 4) END AS f1,
  CASE WHEN ne = 0 OR (me = ne AND no > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM y""")
def citation_prf(spark, d):
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    return E.citation_prf(queries, MQ.cited_lines(spark, d), MQ.expected_orders(spark, d).filter("query_id % 7 > 0"))


@query("eval_hit_fallback", f"""WITH {I.RRF_RUN}, {MQ.GOLD}, m AS (SELECT r.query_id, bool_or({MQ.MATCHED}) AS hit FROM run r JOIN chunks c USING (chunk_id) WHERE r.rank <= 5 GROUP BY r.query_id)
SELECT item_id AS query_id, item_id % 5 = 0 AS abstain, CASE WHEN item_id % 5 > 0 AND item_id % 3 > 0 THEN item_id % 2 > 0 ELSE coalesce(hit, false) END AS citation_hit FROM benchmark LEFT JOIN m ON m.query_id = item_id""")
def eval_hit_fallback(spark, d):
    q = F.col("query_id")
    outputs = I.queries(spark, d).select("query_id", (q % 5 == 0).alias("abstain"), (q % 3).alias("n_citations"), (q % 2).cast("double").alias("recall"))
    out = E.hit_with_fallback(outputs, MQ.run_rows(spark, d, I.rrf_run(spark, d)), MQ.gold(spark, d))
    return out.select("query_id", "abstain", "citation_hit")


@query("version_comparison", "WITH " + f"{I.BM25}, {I.TFIDF}, {I.DENSE}, {I.sql_rrf(10)}, {MQ.GOLD}, full_chain AS (WITH {RQ.HYBRID} SELECT query_id, chunk_id, rank FROM hybrid WHERE rank <= 10), " + """runs AS (SELECT 'bm25' AS version, query_id, chunk_id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT 'tfidf', query_id, chunk_id, rank FROM tfidf WHERE rank <= 10
  UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM rrf
  UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM full_chain),
h AS (SELECT version, r.query_id, min(r.rank) AS best FROM runs r JOIN chunks c USING (chunk_id) WHERE """ + MQ.HIT + f""" GROUP BY ALL),
pq AS (SELECT v.version, item_id, CASE WHEN best <= 1 THEN 1 ELSE 0 END AS hit1, CASE WHEN best <= 3 THEN 1 ELSE 0 END AS hit3, CASE WHEN best <= 5 THEN 1 ELSE 0 END AS hit5, CASE WHEN best <= 5 THEN round(1.0::DOUBLE / best, 4) ELSE 0.0::DOUBLE END AS mrr
  FROM benchmark CROSS JOIN (VALUES ('bm25'), ('tfidf'), ('dense'), ('rrf'), ('hybrid')) v(version) LEFT JOIN h ON h.query_id = item_id AND h.version = v.version)
SELECT version, {_RECALL} FROM pq GROUP BY version""")
def version_comparison(spark, d):
    """Three single lists, their fusion, and the full chain with pair scores; the chain's own two lists serve all that need them."""
    keyword = stored(R.bm25_topk(I.chunks(spark, d), I.queries(spark, d), RQ.K), "keyword")
    dense = stored(R.dense_topk(I.chunk_vectors(spark, d), I.query_vectors(spark, d), RQ.K), "dense")
    first = {"bm25": keyword.filter(F.col("rank") <= I.RUN_K), "dense": dense.filter(F.col("rank") <= I.RUN_K)}
    chain = RQ.hybrid(spark, d, 10, first_stage=(keyword, dense)).withColumn("score", F.col("score_rerank"))
    runs = {**first, "tfidf": I.tfidf_run(spark, d), "rrf": stored(R.rrf_merge(list(first.values())), "rrf"), "hybrid": stored(chain, "chain")}
    shaped = {name: MQ.run_rows(spark, d, run) for name, run in runs.items()}
    return E.compare_versions(shaped, I.queries(spark, d), MQ.gold(spark, d))


@query("evaluate_with_retriever", f"""WITH {I.BM25_RUN}, {MQ.GOLD}, m AS (SELECT r.query_id, bool_or({MQ.MATCHED}) AS hit FROM run r JOIN chunks c USING (chunk_id) WHERE r.rank <= 5 GROUP BY r.query_id)
SELECT count(*) AS total_samples, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 4) AS citation_hit_rate, 1.0::DOUBLE AS pass_rate, 0.0::DOUBLE AS error_rate FROM benchmark LEFT JOIN m ON m.query_id = item_id""")
def evaluate_with_retriever(spark, d):
    gold = I.queries(spark, d).join(MQ.gold(spark, d), "query_id", "left")
    retriever = lambda q: MQ.run_rows(spark, d, R.bm25_topk(I.chunks(spark, d), q, 10))
    return E.evaluate(gold, retriever)[1].select("total_samples", "citation_hit_rate", "pass_rate", "error_rate")


@query("retrieval_audit", f"""WITH {RQ.HYBRID} SELECT query_id, 'c' || (query_id % 10) AS category, rank, chunk_id, round(dense_score, 6) AS score_retrieval, round(score_rerank, 6) AS score_rerank, source AS van_ban, lang AS dieu, 'ok' AS status
FROM hybrid JOIN documents ON doc_id = chunk_id WHERE rank <= 5""")
def retrieval_audit(spark, d):
    from statuta.operators.boosts import with_text

    suite = I.queries(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 10).cast("string")))
    found = RQ.hybrid(spark, d, 5, suite.select("query_id", "query"))
    rows = with_text(found, I.chunks(spark, d), 5 * suite.count(), ("van_ban", "dieu"))
    out = suite.select("query_id", "category").join(rows, "query_id", "left")
    return out.select(
        "query_id", "category", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score_retrieval", 6).alias("score_retrieval"),
        F.round("score_rerank", 6).alias("score_rerank"), "van_ban", "dieu", F.when(F.col("chunk_id").isNull(), F.lit("empty")).otherwise("ok").alias("status"),
    )


_SETTINGS = {"timestamp": "2026-01-01 00:00:00", "run_date": "2026-01-01", "top_k_retrieve": 80, "max_ce_candidates": 25, "llm_backend": "none", "llm_model": ""}
_ANSWER_COLUMNS = {"api_failed": False, "fallback_to_local": False, "retry_count": 0, "error": "", "status": "ok", "latency_retrieve_ms": 1.5, "latency_rerank_ms": 0.5, "latency_context_ms": 0.25, "latency_llm_ms": 2.0, "latency_total_ms": 4.25}


def _sql_value(v):
    return lit(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::INTEGER"


_FIXED = ", ".join(f"{_sql_value(v)} AS {k}" for k, v in {**_SETTINGS, **_ANSWER_COLUMNS}.items())
_TIER_REASON = """CASE WHEN tier = 'local' THEN 'Score ' || printf('%.4f', top1) || ' >= ' || printf('%.4f', tier_local_min_score) || ', Margin ' || printf('%.4f', margin) || ' >= ' || printf('%.4f', tier_local_min_margin)
  WHEN tier = 'api' AND decision = 'cautious' THEN 'CAUTIOUS → route to API for better generation' WHEN tier = 'api' THEN 'Score ' || printf('%.4f', top1) || ' or Margin ' || printf('%.4f', margin) || ' low → API' ELSE 'Score thấp / Abstain → không gọi LLM' END"""


@query("query_log_rows", f"""WITH RECURSIVE {DQ.FEATURES}, {DQ.sql_gate(['sigmoid'])}, {DQ.DIVERSE[DQ.DIVERSE.index('src AS'):]}, kept AS (SELECT query_id, count(*) AS n FROM chosen GROUP BY query_id), r1 AS (SELECT query_id, chunk_id, score FROM scored WHERE rank = 1)
SELECT query_id, query, threshold_pass, tier_local_min_score, tier, {_TIER_REASON} AS tier_reason, decision AS gating_decision, rule AS gating_reason, round(confidence, 6) AS gating_confidence, round(confidence_final, 6) AS confidence_final, round(similarity, 6) AS semantic_similarity,
  round(overlap, 6) AS lexical_overlap, query_type, CAST(floor(len(context) / 1.5::DOUBLE) AS BIGINT) AS context_token_length, round(top1, 6) AS score_rerank_top1, round(top2, 6) AS score_rerank_top2, round(margin, 6) AS margin, round(coalesce(r1.score, 0), 6) AS score_retrieval_top1,
  n_chunks AS num_chunks_retrieved, coalesce(kept.n, 0) AS num_chunks_after_dedup, coalesce(r1.chunk_id, -1) AS top1_chunk_id, coalesce(substr(top_text, 1, 100), '') AS top1_text_preview, substr(repeat(query || ' ', 3), 1, 500) AS generated_answer, len(repeat(query || ' ', 3)) AS answer_length,
  2::BIGINT AS num_citations, '**Luật**: Điều 5, Khoản 2, Điều 7' AS citations_str, query_id % 2 = 0 AS citation_hit, {_FIXED} FROM gated LEFT JOIN kept USING (query_id) LEFT JOIN r1 USING (query_id)""")
def query_log_rows(spark, d):
    """One log row of all fixed columns per query."""
    ranked = DQ.scored(spark, d)
    decided = D.gate(DQ.features(spark, d), [D.profile("sigmoid", V.GATE_PRESETS["sigmoid"])])
    kept = X.diversify(DQ.with_sources(spark, d)).groupBy("query_id").agg(F.count("*").alias("n_chunks_kept"))
    cite = lambda vb, dieu, khoan: F.struct(F.lit(vb).alias("van_ban"), F.lit(dieu).alias("dieu"), F.lit(khoan).alias("khoan"), F.lit("").alias("diem"))
    answers = I.queries(spark, d).select(
        "query_id", F.repeat(F.concat("query", F.lit(" ")), 3).alias("answer"), F.array(cite("Luật", "5", "2"), cite("", "7", "")).alias("citations"),
        (F.col("query_id") % 2 == 0).alias("citation_hit"), *[F.lit(v).alias(k) for k, v in _ANSWER_COLUMNS.items()],
    )
    out = D.log_rows(decided, ranked.withColumnRenamed("score", "score_retrieval"), answers, kept, _SETTINGS)
    rounded = ("gating_confidence", "confidence_final", "semantic_similarity", "lexical_overlap", "score_rerank_top1", "score_rerank_top2", "margin", "score_retrieval_top1")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


# ---- sources and sinks ------------------------------------------------------


@query("jsonl_scan", """WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 7 = 0 THEN substr(props, 1, len(props) - 1) ELSE props END AS l FROM events)
SELECT CAST(json_extract(l, '$.k') AS BIGINT) AS k, count(*) AS n, (SELECT count(*) FROM x WHERE trim(l) <> '' AND NOT json_valid(l)) AS n_malformed FROM x WHERE trim(l) <> '' AND json_valid(l) GROUP BY 1""")
def jsonl_scan(spark, d):
    key = F.col("event_id")
    line = F.when(key % 11 == 0, F.lit("  ")).when(key % 7 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    path = fresh(spark, "lines")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = SL.read_json_lines(spark, path, "k bigint")
    return good.groupBy("k").agg(F.count("*").alias("n")).withColumn("n_malformed", bad.select("n_malformed").scalar())


@query("metadata_store_scan", """SELECT CASE WHEN doc_id % 4 = 3 THEN -1 ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 7 = 6 THEN '' ELSE text END AS text, CASE WHEN doc_id % 3 = 2 THEN 0.0::DOUBLE ELSE doc_id / 10.0::DOUBLE END AS score_retrieval,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS van_ban, lang AS dieu, CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END AS source_file FROM documents""")
def metadata_store_scan(spark, d):
    key = F.col("doc_id")
    text = F.col("text")
    meta = F.struct(F.when(key % 2 == 0, F.col("source")).alias("van_ban"), F.col("lang").alias("dieu"), F.when(key % 2 == 1, F.col("source")).alias("source_file"))
    record = F.struct(
        F.when(key % 4 < 2, key).alias("chunk_id"), F.when(key % 4 == 2, key).alias("faiss_id"), F.when(key % 7 < 3, text).alias("text"),
        F.when((key % 7 >= 3) & (key % 7 < 6), text).alias("passage"), F.when(key % 3 == 0, key / 10).alias("score_retrieval"),
        F.when(key % 3 == 1, key / 10).alias("faiss_score"), F.when(key % 5 < 3, meta).alias("metadata"), F.when(key % 5 >= 3, meta).alias("meta"),
    )
    lines = table(spark, d, "documents").select(F.to_json(record).alias("value"))
    records = lines.select(F.from_json("value", SD.CHUNK_RECORD).alias("r")).select("r.*")
    return SD.chunk_records(records).select("chunk_id", "text", "score_retrieval", "van_ban", "dieu", "source_file")


@query("reranked_scan", f"""WITH {I.RRF_RUN} SELECT 'q' || query_id AS id, rank, chunk_id, text, round(score, 6) AS score_rerank, source AS van_ban, lang AS dieu, CAST(doc_id % 7 AS VARCHAR) AS khoan, CASE WHEN doc_id % 3 = 0 THEN 'a' END AS diem
FROM run JOIN documents ON doc_id = chunk_id WHERE rank <= 5""")
def reranked_scan(spark, d):
    rows = MQ.run_rows(spark, d, I.rrf_run(spark, d).filter("rank <= 5"), ("text", "van_ban", "dieu", "khoan", "diem"))
    item = F.struct("rank", "chunk_index", F.col("text").alias("passage"), F.round("score", 6).alias("ce_score"), "van_ban", "dieu", F.col("khoan").cast("int").alias("khoan"), "diem")
    nested = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("top5_reranked"))
    records = nested.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), "top5_reranked")
    return SD.reranked_rows(records).withColumn("rank", F.col("rank").cast("long"))


@query("file_registry", """WITH x AS (SELECT 'f' || page_id || CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PDF' END AS path, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS c FROM pages)
SELECT path, octet_length(encode(c)) AS length, sha256(c) AS sha256, 'doc_' || substr(sha256(c), 1, 16) AS doc_id, CASE WHEN path LIKE '%.txt' THEN 'not_pdf' WHEN c = '' THEN 'empty' WHEN octet_length(encode(c)) > 3000 THEN 'too_large' ELSE 'accepted' END AS status FROM x""")
def file_registry(spark, d):
    key = F.col("page_id")
    content = F.encode(F.when(key % 11 == 0, F.lit("")).otherwise(F.col("html")), "UTF-8")
    path = F.concat(F.lit("f"), key.cast("string"), F.when(key % 7 == 0, F.lit(".txt")).otherwise(F.lit(".PDF")))
    files = table(spark, d, "pages").select(path.alias("path"), content.alias("content"))
    return SL.file_registry(files.withColumn("length", F.octet_length("content").cast("long")), 3000)


@query("vector_store_write_read", "SELECT vec_id AS chunk_id, " + I.sql_round('list_sum(list_transform(embedding, lambda x: x::DOUBLE))') + " AS total, CAST(len(embedding) AS BIGINT) AS dim, true AS valid FROM embeddings")
def vector_store_write_read(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = vectors.select("chunk_id")
    back = VE.write_vectors(vectors, chunks, fresh(spark, "vectors"), 64)
    ok = VE.vector_checks(back, chunks, 64).select("valid").scalar()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.select("chunk_id", F.round(total, 6).alias("total"), F.size("embedding").cast("long").alias("dim")).withColumn("valid", ok)


@query("metrics_long_csv", f"""WITH {I.RRF_RUN}, {HITS}, {PER_QUERY}, m AS (SELECT {_RECALL} FROM pq) UNPIVOT (SELECT 'hybrid' AS version, * EXCLUDE n_queries FROM m) ON recall_at_1, recall_at_3, recall_at_5, mrr_at_5 INTO NAME metric VALUE value""")
def metrics_long_csv(spark, d):
    metrics = E.recall_mrr(per_query(spark, d)).withColumn("version", F.lit("hybrid"))
    long = SL.metrics_long(metrics, ["recall_at_1", "recall_at_3", "recall_at_5", "mrr_at_5"], ["version"])
    return SL.write_csv(long, fresh(spark, "metrics"))


@query("eval_rows_export", f"""WITH {PQ.LOG} SELECT CAST(query_id AS VARCHAR) AS query_id, 'q ' || query_id AS query, gating_decision, tier, citation_hit, citation_precision, citation_recall, citation_f1, gating_decision = 'abstain' AS abstain, latency_llm_ms, latency_total_ms, nullif(error, '') AS error,
  (SELECT count(*) FROM log) AS n_json FROM log""")
def eval_rows_export(spark, d):
    rows = PQ.log(spark, d).withColumns(
        {"query_id": F.col("query_id").cast("string"), "query": F.concat(F.lit("q "), F.col("query_id").cast("string")), "abstain": F.col("gating_decision") == "abstain", "error": F.when(F.col("error") != "", F.col("error"))}
    )
    csv, rows_json = SL.export_eval(rows, fresh(spark, "eval"))
    return csv.withColumn("n_json", rows_json.agg(F.count("*")).scalar())


@query("log_append_sink", f"""WITH {PQ.LOG} SELECT query_id, tier, CASE WHEN query_id % 2 = 1 THEN gating_decision END AS gating_decision, latency_total_ms FROM log""")
def log_append_sink(spark, d):
    rows, path = PQ.log(spark, d), fresh(spark, "log")
    SL.append_log(rows.filter("query_id % 2 = 0").select("query_id", "tier", "latency_total_ms"), path)
    SL.append_log(rows.filter("query_id % 2 = 1").select("query_id", "tier", "gating_decision", "latency_total_ms", F.lit(1).alias("unknown")), path)
    return SL.read_log(spark, path, "query_id bigint, tier string, gating_decision string, latency_total_ms double")


@query("chat_store_scan", "SELECT m.conv_id, c_custkey AS user_id, c_name AS name, turn, role, len(text) AS chars FROM conversations m JOIN customer ON c_custkey = conv_id % 60")
def chat_store_scan(spark, d):
    messages = table(spark, d, "conversations")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    convs = messages.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 60).alias("user_id"), F.lit(V.DEFAULT_CHAT_TITLE).alias("title"))
    u, c, m = SL.chat_store(users, convs, messages)
    return m.join(c, "conv_id").join(u, "user_id").select("conv_id", "user_id", "name", "turn", "role", F.length("content").cast("long").alias("chars"))


# ---- stores -----------------------------------------------------------------


@query("store_commit", f"""WITH c AS (SELECT doc_id, text FROM documents)
SELECT (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM c) AS n_vectors, (SELECT count(*) FROM c WHERE len({sql_tokens('text')}) > 0) AS n_postings, true AS consistent, true AS published, true AS rejected""")
def store_commit(spark, d):
    root = fresh(spark, "store")
    chunks, both = I.chunks(spark, d), I.chunk_vectors(spark, d)
    odd = "chunk_id % 2 = 1"
    ST.commit(spark, root, chunks.filter(f"NOT {odd}"), both.filter(f"NOT {odd}"))
    version = ST.append(spark, root, chunks.filter(odd), both.filter(odd))
    try:
        ST.commit(spark, root, chunks, both.filter(odd))
        rejected = False
    except ValueError:
        rejected = True
    published = ST.current_version(spark, root) == version
    return ST.store_stats(ST.read_version(spark, root, version)).withColumns({"published": F.lit(published), "rejected": F.lit(rejected)})


@query("store_repair", f"""WITH x AS (SELECT doc_id, starts_with(source, 'src1') AND lang = 'en' AND doc_id % 7 IN (1, 3) AND contains(text, ' the ') AS hit, text FROM documents),
y AS (SELECT doc_id, hit AS repaired, CASE WHEN hit THEN replace(text, ' the ', ' THEE ') ELSE text END AS text FROM x), t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM y)
SELECT doc_id, repaired, md5(text) AS text_md5, (SELECT count(*) FROM t WHERE term = 'thee') AS n_term FROM y""")
def store_repair(spark, d):
    root = fresh(spark, "store")
    old = ST.commit(spark, root, I.chunks(spark, d), I.chunk_vectors(spark, d))
    target = F.col("van_ban").startswith("src1") & (F.col("dieu") == "en") & F.col("khoan").isin("1", "3")
    try:
        new = ST.repair_version(spark, root, target, " the ", " THEE ")
    except LookupError:  # a table without such rows: the version stays
        new = old
    before, after = ST.read_version(spark, root, old), ST.read_version(spark, root, new)
    again = after["postings"].filter("term = 'thee'").agg(F.sum("tf")).scalar()
    was = before["chunks"].select("chunk_id", F.md5("text").alias("was"))
    rows = after["chunks"].select("chunk_id", F.md5("text").alias("text_md5")).join(was, "chunk_id")
    return rows.select(F.col("chunk_id").alias("doc_id"), (F.col("text_md5") != F.col("was")).alias("repaired"), "text_md5", F.coalesce(again, F.lit(0)).alias("n_term"))


@query("store_stats", f"SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents WHERE len({sql_tokens('text')}) > 0) AS n_postings, (SELECT count(*) FROM documents) = (SELECT count(*) FROM embeddings) AS consistent")
def store_stats(spark, d):
    chunks = I.chunks(spark, d)
    return ST.store_stats({"chunks": chunks, "vectors": table(spark, d, "embeddings"), "postings": R.postings(chunks)})
