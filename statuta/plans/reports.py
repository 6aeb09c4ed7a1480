"""Queries over audits, summaries, calibration and windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.operators import answers as A
from statuta.operators import reports as P
from statuta.plans import inputs as I
from statuta.plans import matching as MQ
from statuta.plans.inputs import lit, sql_any, sql_strip
from statuta.plans.registry import query
from statuta.sources.tables import table

# ---- the event table read as a query log ------------------------------------


def log(spark, d):
    return log_of(table(spark, d, "events"))


def log_of(e):
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("query_id"), "ts",
        F.element_at(F.array(F.lit("local"), F.lit("api"), F.lit("none")), (F.col("user_id") % 3 + 1).cast("int")).alias("tier"),
        F.when(kind.isin("click", "purchase"), F.lit("answer")).when(kind == "view", F.lit("cautious")).when(kind == "error", F.lit("abstain")).otherwise("ask_back").alias("gating_decision"),
        (F.col("value") / 10).alias("score_rerank_top1"), (F.col("event_id") % 7 * 0.1).alias("margin"), F.col("value").alias("latency_total_ms"),
        F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value") / 2).alias("latency_llm_ms"),
        F.when(F.col("event_id") % 6 == 0, 0.0).otherwise(F.col("value") / 4).alias("latency_retrieve_ms"),
        F.when((kind == "error") & (F.col("value") > 20), F.lit("boom")).otherwise("").alias("error"),
        (F.col("event_id") % 3 == 0).alias("citation_hit"), ((F.col("event_id") % 5) / 4).alias("citation_precision"),
        ((F.col("event_id") % 3) / 2).alias("citation_recall"), ((F.col("event_id") % 9) / 8).alias("citation_f1"),
    )


LOG = """log AS (SELECT event_id AS query_id, ts, ['local', 'api', 'none'][user_id % 3 + 1] AS tier, CASE WHEN event_type IN ('click', 'purchase') THEN 'answer' WHEN event_type = 'view' THEN 'cautious' WHEN event_type = 'error' THEN 'abstain' ELSE 'ask_back' END AS gating_decision,
  value / 10 AS score_rerank_top1, event_id % 7 * 0.1::DOUBLE AS margin, value AS latency_total_ms, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE value / 2 END AS latency_llm_ms, CASE WHEN event_id % 6 = 0 THEN 0.0::DOUBLE ELSE value / 4 END AS latency_retrieve_ms,
  CASE WHEN event_type = 'error' AND value > 20 THEN 'boom' ELSE '' END AS error, event_id % 3 = 0 AS citation_hit, event_id % 5 / 4.0::DOUBLE AS citation_precision, event_id % 3 / 2.0::DOUBLE AS citation_recall, event_id % 9 / 8.0::DOUBLE AS citation_f1 FROM events)"""


@query("corpus_audit", f"""WITH x AS (SELECT {sql_strip("CASE WHEN doc_id % 50 = 0 THEN '  ' WHEN doc_id % 50 = 1 THEN substr(text, 1, 30) ELSE text END")} AS t, doc_id % 11 = 0 AS em FROM documents),
k AS (SELECT substr({I.sql_collapsed('t')}, 1, 500) AS k FROM x)
SELECT count(*) AS total, count(*) FILTER (len(t) = 0) AS empty_chunks, count(*) FILTER (len(t) BETWEEN 1 AND 49) AS short_chunks, count(*) FILTER (len(t) > 3000) AS long_chunks,
  min(len(t)) AS length_min, max(len(t)) AS length_max, round(avg(len(t)), 1) AS length_avg, (SELECT count(*) - count(DISTINCT k) FROM k) AS duplicates, count(*) FILTER (em) AS empty_metadata FROM x""")
def corpus_audit(spark, d):
    key = F.col("doc_id") % 50
    text = F.when(key == 0, F.lit("  ")).when(key == 1, F.left("text", F.lit(30))).otherwise(F.col("text"))
    return P.corpus_audit(I.documents(spark, d).select(text.alias("text"), (F.col("doc_id") % 11 == 0).alias("empty_metadata")))


@query("missing_fields", """WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS van_ban, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS dieu, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars END AS page_start, text FROM documents)
SELECT unnest(['van_ban', 'dieu', 'page_start', 'text']) AS field, unnest([count(*) FILTER (coalesce(van_ban, '') = ''), count(*) FILTER (coalesce(dieu, '') = ''), count(*) FILTER (page_start IS NULL), count(*) FILTER (coalesce(text, '') = '')]) AS missing FROM x""")
def missing_fields(spark, d):
    key = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.when(key % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("van_ban"), F.when(key % 4 != 0, F.col("lang")).alias("dieu"),
        F.when(key % 9 != 0, F.col("n_chars")).alias("page_start"), "text",
    )
    return P.missing_fields(rows, ["van_ban", "dieu", "page_start", "text"])


@query("top_groups", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_groups(spark, d):
    return P.top_groups(table(spark, d, "documents"), "source")


@query("count_consistency", "SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM documents WHERE text <> '') AS n_corpus, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AND (SELECT count(*) FROM documents) = (SELECT count(*) FROM documents WHERE text <> '') AS consistent")
def count_consistency(spark, d):
    docs = table(spark, d, "documents")
    return P.count_consistency(table(spark, d, "embeddings"), docs, docs.filter("text <> ''"))


_SUMMARY = """SELECT count(*) AS total_samples, round(avg(CAST(citation_hit AS INTEGER)), 4) AS citation_hit_rate, round(avg(citation_precision), 4) AS avg_citation_precision, round(avg(citation_recall), 4) AS avg_citation_recall, round(avg(citation_f1), 4) AS avg_citation_f1,
  round(avg(CAST(gating_decision = 'answer' AS INTEGER)), 4) AS pass_rate, round(avg(CAST(gating_decision = 'abstain' AS INTEGER)), 4) AS abstain_rate, round(avg(CAST(gating_decision = 'ask_back' AS INTEGER)), 4) AS ask_back_rate, round(avg(CAST(gating_decision = 'cautious' AS INTEGER)), 4) AS cautious_rate,
  round(avg(latency_llm_ms), 2) AS avg_latency_llm_ms, round(avg(latency_total_ms), 2) AS avg_latency_total_ms, round(avg(CAST(error <> '' AS INTEGER)), 4) AS error_rate"""


@query("eval_summary", f"WITH {LOG} {_SUMMARY} FROM log")
def eval_summary(spark, d):
    return P.eval_summary(log(spark, d))


@query("run_summary", f"""WITH {MQ.CITED_PAIRS}, q AS (SELECT o_orderkey AS query_id, ['local', 'api', 'none'][o_orderkey % 3 + 1] AS tier, ['answer', 'cautious', 'abstain', 'ask_back'][o_custkey % 4 + 1] AS decision, o_custkey % 5 = 0 AS abstain, o_orderstatus = 'P' AS is_error FROM orders),
h AS (SELECT query_id, count(DISTINCT out_no) AS hits FROM mt GROUP BY query_id), x AS (SELECT q.*, CASE WHEN abstain THEN 0 ELSE coalesce(hits, 0) END AS hits FROM q LEFT JOIN h USING (query_id))
SELECT count(*) AS total, count(*) FILTER (tier = 'local') AS n_local, count(*) FILTER (tier = 'api') AS n_api, count(*) FILTER (tier = 'none') AS n_none, round(sum(hits) / count(*)::DOUBLE, 4) AS citation_hit_rate, round(count(*) FILTER (hits > 0) / count(*)::DOUBLE, 4) AS query_hit_rate,
  round(count(*) FILTER (decision IN ('answer', 'cautious')) / count(*)::DOUBLE, 4) AS pass_rate, round(count(*) FILTER (is_error) / count(*)::DOUBLE, 4) AS error_rate, round(count(*) FILTER (tier <> 'api') * 100 / count(*)::DOUBLE, 1) AS savings_percent FROM x""")
def run_summary(spark, d):
    from statuta.operators.matching import citation_pairs

    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    outputs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("query_id"), pick(("local", "api", "none"), F.col("o_orderkey") % 3).alias("tier"),
        pick(("answer", "cautious", "abstain", "ask_back"), F.col("o_custkey") % 4).alias("decision"),
        (F.col("o_custkey") % 5 == 0).alias("abstain"), (F.col("o_orderstatus") == "P").alias("is_error"),
    )
    return P.run_summary(outputs, citation_pairs(MQ.cited_lines(spark, d), MQ.expected_orders(spark, d)))


@query("log_summary", f"""WITH {LOG}, n AS (SELECT count(*) AS t FROM log) SELECT 'tier' AS part, tier AS name, count(*) AS n, round(count(*) / any_value(t)::DOUBLE, 4) AS rate, NULL::DOUBLE AS value FROM log, n GROUP BY tier
UNION ALL SELECT 'decision', gating_decision, count(*), round(count(*) / any_value(t)::DOUBLE, 4), NULL FROM log, n GROUP BY gating_decision
UNION ALL SELECT 'overall', unnest(['avg_latency_total_ms', 'error_rate', 'api_savings_rate']), count(*), NULL, unnest([round(avg(latency_total_ms), 1), round(avg(CAST(error <> '' AS INTEGER)), 4), round(avg(CAST(tier <> 'api' AS INTEGER)), 4)]) FROM log""")
def log_summary(spark, d):
    return P.log_summary(log(spark, d))


_STAGES = {"Retrieve": "latency_retrieve_ms", "LLM": "latency_llm_ms", "TOTAL": "latency_total_ms"}


@query("latency_stats", f"""WITH {LOG}, u AS ({" UNION ALL ".join(f"SELECT '{k}' AS stage, {c} AS ms FROM log" for k, c in _STAGES.items())})
SELECT stage, round(avg(ms), 1) AS mean_ms, round(min(ms), 1) AS min_ms, round(max(ms), 1) AS max_ms FROM u WHERE ms > 0 GROUP BY stage""")
def latency_stats(spark, d):
    return P.latency_stats(log(spark, d), _STAGES)


@query("tier_breakdown", f"""WITH {LOG}, l AS (SELECT * FROM log WHERE tier <> 'none'), t AS (SELECT unnest(['local', 'api', 'none']) AS tier), n AS (SELECT count(*) AS total, count(*) FILTER (tier <> 'api') AS saved FROM l),
s AS (SELECT tier, count(*) AS n, round(avg(score_rerank_top1), 2) AS avg_score, round(avg(margin), 2) AS avg_margin, round(avg(latency_total_ms), 1) AS avg_latency_ms, count(*) FILTER (error <> '') AS errors FROM l GROUP BY tier)
SELECT tier, coalesce(s.n, 0) AS n, round(coalesce(s.n, 0) / total::DOUBLE, 3) AS share, avg_score, avg_margin, avg_latency_ms, coalesce(errors, 0) AS errors, round(saved * 100 / total::DOUBLE, 1) AS savings_percent FROM t LEFT JOIN s USING (tier), n""")
def tier_breakdown(spark, d):
    return P.tier_breakdown(log(spark, d).filter("tier <> 'none'"))


@query("gating_quality", """WITH x AS (SELECT ['answer', 'cautious', 'abstain', 'ask_back', 'answer'][doc_id % 5 + 1] AS d, quality = 1 AS ok FROM labels), c AS (SELECT count(*) FILTER (d IN ('answer', 'cautious') AND ok) AS tp, count(*) FILTER (d NOT IN ('answer', 'cautious') AND NOT ok) AS tn,
  count(*) FILTER (d IN ('answer', 'cautious') AND NOT ok) AS fp, count(*) FILTER (d NOT IN ('answer', 'cautious') AND ok) AS fn, count(*)::DOUBLE AS n FROM x)
SELECT round(tp / (tp + fp)::DOUBLE, 4) AS pass_precision, round(tn / (tn + fn)::DOUBLE, 4) AS abstain_precision, round((tn + fn) / n, 4) AS abstain_rate, round(fp / n, 4) AS false_positive_rate, round(tp / n, 4) AS true_positive_rate FROM c""")
def gating_quality(spark, d):
    pick = F.element_at(F.array(*map(F.lit, ("answer", "cautious", "abstain", "ask_back", "answer"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return P.gating_quality(table(spark, d, "labels").select(pick.alias("decision"), (F.col("quality") == 1).alias("answerable")))


@query("score_percentiles", """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
p AS (SELECT n AS total, """ + ", ".join(f"max(CASE WHEN i = CAST(floor(n * {p}::DOUBLE) AS BIGINT) THEN value END) AS {k}" for k, p in P.PERCENTILES.items()) + """ FROM s GROUP BY n)
SELECT *, p75 AS threshold_pass, p50 AS threshold_cautious, p10 AS threshold_abstain FROM p""")
def score_percentiles(spark, d):
    return P.score_percentiles(table(spark, d, "events").select(F.col("value").alias("score")))


@query("score_percentile_rank", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round((rank() OVER (ORDER BY l_extendedprice) - 1) / count(*) OVER ()::DOUBLE, 6) AS percentile FROM lineitem""")
def score_percentile_rank(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return P.percentile_rank(rows, "l_extendedprice").withColumn("percentile", F.round("percentile", 6))


# ---- windows ----------------------------------------------------------------


@query("top12_margin", f"""WITH {I.RRF_RUN}, x AS (SELECT * FROM run WHERE query_id % 5 > 0 OR rank = 1), t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS top2 FROM x GROUP BY query_id)
SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, {I.sql_round('(top1 - top2)')} AS margin FROM t""")
def top12_margin(spark, d):
    run = I.rrf_run(spark, d).filter("query_id % 5 > 0 or rank = 1")
    return P.top_margin(run).select("query_id", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")])


@query("ablation_lift", """WITH m AS (SELECT month(o_orderdate) AS step, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS r1, avg(CAST(o_orderstatus <> 'O' AS INTEGER)) AS r5 FROM orders GROUP BY 1),
l AS (SELECT step, 'r1' AS metric, r1 AS value FROM m UNION ALL SELECT step, 'r5', r5 FROM m)
SELECT CAST(step AS BIGINT) AS step, metric, round(value, 6) AS value, round((value - first_value(value) OVER w) * 100, 2) AS vs_first_pp, round((value - lag(value) OVER w) * 100, 2) AS step_pp, round(value / first_value(value) OVER w - 1, 4) AS relative FROM l WINDOW w AS (PARTITION BY metric ORDER BY step)""")
def ablation_lift(spark, d):
    flag = lambda c: F.avg(c.cast("double"))
    v = table(spark, d, "orders").groupBy(F.month("o_orderdate").cast("long").alias("step")).agg(
        flag(F.col("o_orderstatus") == "F").alias("r1"), flag(F.col("o_orderstatus") != "O").alias("r5")
    )
    return P.ablation_lift(v, ["r1", "r5"]).withColumn("value", F.round("value", 6))


_MARKS = ["tion", "heit", "que"]


@query("follow_up_rewrite", f"""WITH u AS (SELECT conv_id, turn, t, {I.sql_collapsed('t')} AS norm FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN min(text) OVER (PARTITION BY conv_id) ELSE text END AS t FROM conversations WHERE role = 'user')),
p AS (SELECT a.conv_id, a.turn, arg_max(b.t, b.turn) AS prev FROM u a JOIN u b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.norm <> a.norm AND b.norm <> '' GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND {sql_any('norm', _MARKS)} THEN 'Câu hỏi trước: ' || {sql_strip('prev')} || chr(10) || 'Câu hỏi tiếp nối cần trả lời đầy đủ: ' || t ELSE t END AS rewritten FROM u LEFT JOIN p USING (conv_id, turn)""")
def follow_up_rewrite(spark, d):
    users = I.turns(spark, d, "user")
    least = users.groupBy("conv_id").agg(F.min("text").alias("least"))
    same = (F.col("turn") % 4 == 2) & (F.col("conv_id") % 3 == 0)
    messages = users.join(least, "conv_id").withColumn("text", F.when(same, F.col("least")).otherwise(F.col("text"))).withColumn("role", F.lit("user"))
    return A.follow_up_rewrite(messages, _MARKS)


@query("history_window", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM x WHERE age <= 3""")
def history_window(spark, d):
    out = A.history_window(table(spark, d, "conversations").select("conv_id", "turn", "role"), 3)
    return out.withColumn("position", F.col("position").cast("long"))


@query("first_occurrence", """WITH x AS (SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS part, doc_id, text, source FROM documents WHERE text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, doc_id) AS n FROM x) SELECT doc_id, md5(text) AS text_md5, source, part FROM r WHERE n = 1""")
def first_occurrence(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text", "source", "lang")
    early = F.col("source").isin("src1", "src2", "src3")
    parts = [docs.filter(early), docs.filter(~early & (F.col("lang") == "en")), docs.filter(~early & (F.col("lang") != "en"))]
    return P.first_occurrence(parts, "text", "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "source", F.col("_part").alias("part"))


@query("trailing_request_count", """SELECT event_id, user_id AS client, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS trailing FROM events""")
def trailing_request_count(spark, d):
    requests = table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), "ts")
    return P.trailing_count(requests, 7200, 86400).drop("ts")
