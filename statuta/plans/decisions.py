"""Queries over decisions and contexts."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions import keywords as K
from statuta.operators import boosts as B
from statuta.operators import context as X
from statuta.operators import decisions as D
from statuta.plans import inputs as I
from statuta.plans.inputs import lit, sql_case, sql_list, sql_strip
from statuta.plans.registry import query
from statuta.plans.scalars import sql_clarification, sql_gate_question, sql_generic_question, sql_missing, sql_query_type, sql_sigmoid
from statuta.sources.tables import table

# ---- ranked chunks with scores of several scales; every ninth query has none ----

_SCALE = [1.0, 0.05, 0.01, 0.001]


def scored(spark, d):
    run = I.bm25_run(spark, d).filter("query_id % 9 > 0")
    texts = B.with_text(run, I.chunks(spark, d), run.count(), ("text", "van_ban", "chuong", "dieu", "khoan", "diem", "page_number", "source_file"))
    scale = F.element_at(F.array(*map(F.lit, _SCALE)), (F.col("query_id") % 4 + 1).cast("int"))
    return texts.withColumn("score_rerank", F.col("score") * scale)


def features(spark, d):
    return D.query_features(I.queries(spark, d), scored(spark, d), I.LEXICON)


_LX = I.LEXICON
_FSTOP = sql_list(_LX.fallback_stopwords)
FEATURES = f"""{I.BM25_RUN},
scored AS (SELECT r.query_id, r.chunk_id, r.rank, r.score, t.text, t.source AS van_ban, t.lang AS dieu, r.score * ([1.0, 0.05, 0.01, 0.001]::DOUBLE[])[r.query_id % 4 + 1] AS score_rerank FROM run r JOIN documents t ON t.doc_id = r.chunk_id WHERE r.query_id % 9 > 0),
agg AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN score_rerank END) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score_rerank END), 0) AS top2, max(CASE WHEN rank = 1 THEN text END) AS top_text, max(CASE WHEN rank = 1 THEN van_ban END) AS top_title,
  string_agg(text, ' ' ORDER BY rank) FILTER (rank <= 5) AS context, string_agg(text, ' ' ORDER BY rank) AS all_text FROM scored GROUP BY query_id),
{I.sql_keywords('benchmark', 'item_id', 'text')},
f0 AS (SELECT item_id AS query_id, b.text AS query, lower(b.text) AS low, words, coalesce(n, 0) AS n_chunks, coalesce(top1, 0) AS top1, coalesce(top2, 0) AS top2, {I.sql_round('(coalesce(top1, 0) - coalesce(top2, 0))', 9)} AS margin, top_text, top_title,
  coalesce(context, '') AS context, lower(coalesce(context, '')) AS clow, lower(coalesce(all_text, '')) AS alow FROM benchmark b JOIN kw USING (item_id) LEFT JOIN agg ON agg.query_id = item_id),
f1 AS (SELECT *, CASE WHEN len(words) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(words, lambda w: contains(clow, w))) / len(words)::DOUBLE END AS overlap, list_filter(words, lambda w: contains(alow, w)) AS found, list_filter(words, lambda w: NOT contains(alow, w)) AS missing,
  list_filter(list_distinct(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+')), lambda w: len(w) > 1 AND NOT list_contains({_FSTOP}, w)) AS fw FROM f0),
f AS (SELECT *, CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE round(len(found) / len(words)::DOUBLE, 4) END AS coverage, CASE WHEN len(fw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(fw, lambda w: contains(clow, w))) / len(fw)::DOUBLE END AS fcov,
  {sql_query_type('low')} AS query_type, {sql_clarification('low', 'query')} AS clarify, {sql_missing('low', 'query', 0)} AS mkind, {sql_missing('low', 'query', 1)} AS mquestion,
  {sql_gate_question('low', 'missing')} AS gate_question, {sql_generic_question('low')} AS generic_question FROM f1)"""


@query("lexical_overlap", f"WITH {FEATURES} SELECT query_id, round(overlap, 6) AS overlap FROM f")
def lexical_overlap(spark, d):
    return features(spark, d).select("query_id", F.round("overlap", 6).alias("overlap"))


@query("keyword_coverage", f"WITH {FEATURES} SELECT query_id, coverage, array_to_string(found, ',') AS found, array_to_string(missing, ',') AS missing FROM f")
def keyword_coverage(spark, d):
    return features(spark, d).select(
        "query_id", "cov.coverage", F.array_join("cov.found", ",").alias("found"), F.array_join("cov.missing", ",").alias("missing")
    )


def _value(v):
    return str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE"


def sql_profiles(names):
    rows = []
    for name in names:
        values = {**V.GATE_DEFAULT, **({} if name == "default" else V.GATE_PRESETS[name])}
        rows.append(f"SELECT {lit(name)} AS profile, " + ", ".join(f"{_value(v)} AS {k}" for k, v in values.items()))
    return "prof AS (" + " UNION ALL ".join(rows) + ")"


_EFF = "(CASE WHEN score_is_sigmoid THEN margin ELSE margin / greatest(abs(top1), 1.0) END)"
_THIN = "top1 < threshold_pass AND coverage < min_keyword_coverage"
_RULES = [
    ("n_chunks = 0", "no_chunks", "abstain", "no_relevant_chunk", "none", "NULL"),
    ("top1 < threshold_abstain", "low_score", "abstain", "low_confidence", "none", "NULL"),
    (f"NOT (score_is_sigmoid AND top1 >= threshold_pass) AND {_EFF} < margin_min AND enable_ask_back AND ask_back_on_ambiguous", "margin", "ask_back", "ambiguous_query", "none", lit(V.AMBIGUOUS_QUESTION)),
    (f"{_THIN} AND enable_ask_back", "coverage", "ask_back", "missing_legal_keyword", "none", "gate_question"),
    (_THIN, "coverage", "cautious", "missing_legal_keyword", "api", "NULL"),
    ("overlap < 0.05", "no_overlap", "cautious", "missing_legal_keyword", "api", "NULL"),
    ("overlap < min_lexical_overlap AND top1 < tier_local_min_score", "low_overlap", "cautious", "missing_legal_keyword", "api", "NULL"),
    ("clarify IS NOT NULL AND enable_ask_back", "unclear", "ask_back", "ambiguous_query", "none", "clarify"),
    ("top1 >= threshold_pass", "pass", "answer", None, None, "NULL"),
    ("top1 >= threshold_cautious", "cautious", "cautious", None, "api", "NULL"),
]
_TIER = f"CASE WHEN top1 >= tier_local_min_score AND {_EFF} >= tier_local_min_margin THEN 'local' WHEN top1 >= tier_api_min_score THEN 'api' ELSE 'none' END"


def sql_gate(names, source="f"):
    col = lambda i, last, quote=True: sql_case([(r[0], "NULL" if r[i] is None else (lit(r[i]) if quote else r[i])) for r in _RULES], last)
    tier = sql_case([(r[0], _TIER if r[4] is None else lit(r[4])) for r in _RULES], "'none'")
    return f"""{sql_profiles(names)}, gated AS (SELECT *, {col(1, "'below_pass'")} AS rule, {col(2, "'abstain'")} AS decision, {col(3, "'low_confidence'")} AS reason, {tier} AS tier, {col(5, 'NULL', False)} AS question,
  CASE WHEN n_chunks = 0 THEN 0 ELSE top1 END AS confidence, CASE WHEN n_chunks = 0 THEN 0 ELSE {sql_sigmoid(_EFF + ' * margin_scale - 1.5')} END AS confidence_final,
  CASE WHEN n_chunks = 0 THEN 0 WHEN score_is_sigmoid THEN top1 ELSE {sql_sigmoid('top1 / 5')} END AS similarity FROM {source}, prof)"""


_GATED = """SELECT query_id, profile, rule, decision, reason, tier, question AS clarification_question, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(confidence_final, 6) AS confidence_final,
  round(similarity, 6) AS semantic_similarity, round(overlap, 6) AS lexical_overlap, query_type, CAST(floor(len(context) / 1.5::DOUBLE) AS BIGINT) AS context_tokens FROM gated"""


def shown_gate(df):
    rounded = [F.round(c, 6).alias(c) for c in ("confidence", "margin", "confidence_final", "semantic_similarity", "lexical_overlap")]
    return df.select("query_id", "profile", "rule", "decision", "reason", "tier", "clarification_question", *rounded, "query_type", "context_tokens")


@query("gate", f"WITH {FEATURES}, {sql_gate(['default'])} {_GATED}")
def gate(spark, d):
    return shown_gate(D.gate(features(spark, d), [D.profile("default")]))


@query("gate_profiles", f"WITH {FEATURES}, {sql_gate(list(V.GATE_PRESETS))} {_GATED}")
def gate_profiles(spark, d):
    return shown_gate(D.gate(features(spark, d), [D.profile(n, o) for n, o in V.GATE_PRESETS.items()]))


@query("tier_route", f"""WITH {FEATURES}, {sql_profiles(['sigmoid', 'pair_score'])} SELECT query_id, profile, {_TIER} AS tier FROM f, prof""")
def tier_route(spark, d):
    profiles = F.array(*[D.profile(n, V.GATE_PRESETS[n]) for n in ("sigmoid", "pair_score")])
    out = features(spark, d).withColumn("p", F.explode(profiles))
    return out.select("query_id", "p.profile", D.tier(F.col("top1"), F.col("margin"), F.col("p")).alias("tier"))


@query("quick_gate", f"""WITH {FEATURES} SELECT query_id, n_chunks > 0 AND top1 >= 0.5 AS passed, CASE WHEN n_chunks = 0 THEN 'No chunks available' WHEN top1 < 0.5 THEN 'Top score below threshold' ELSE 'Passed quick gate' END AS reason FROM f""")
def quick_gate(spark, d):
    return features(spark, d).select("query_id", D.quick_gate(F.col("top1"), F.col("n_chunks")).alias("q")).select("query_id", "q.*")


@query("gated_output", f"""WITH {FEATURES}, {sql_gate(['default', 'dense_only'])} SELECT query_id, profile, NULL::VARCHAR AS answer, decision, true AS abstain, reason AS abstain_reason, question AS clarification_question, round(confidence, 6) AS confidence_score FROM gated WHERE decision IN ('abstain', 'ask_back')""")
def gated_output(spark, d):
    out = D.gate(features(spark, d), [D.profile("default"), D.profile("dense_only", V.GATE_PRESETS["dense_only"])])
    return D.gated_output(out).withColumn("confidence_score", F.round("confidence_score", 6))


FALLBACK = """fb AS (SELECT *, CASE WHEN n_chunks = 0 THEN 'abstain' WHEN top1 < 0.3 AND mkind IS NOT NULL THEN 'ask_back' WHEN top1 < 0.3 THEN 'abstain' WHEN top1 < 0.7 AND fcov < 0.3 THEN 'ask_back' WHEN top1 < 0.7 THEN 'cautious' ELSE 'none' END AS ft FROM f),
fbq AS (SELECT *, CASE WHEN ft = 'ask_back' AND top1 < 0.3 THEN mkind END AS missing_type, CASE WHEN ft = 'ask_back' AND top1 < 0.3 THEN mquestion WHEN ft = 'ask_back' THEN generic_question END AS fq FROM fb)"""


@query("fallback", f"WITH {FEATURES}, {FALLBACK} SELECT query_id, ft AS fallback_type, missing_type, fq AS fallback_question, round(fcov, 6) AS coverage FROM fbq")
def fallback(spark, d):
    return D.fallback(features(spark, d)).select("query_id", "fallback_type", "missing_type", "fallback_question", F.round("fallback_coverage", 6).alias("coverage"))


@query("fallback_render", f"""WITH {FEATURES}, {FALLBACK}, a AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN ' ' ELSE ' ' || query || ' ' END AS answer, query_id % 2 AS nc FROM fbq)
SELECT query_id, CASE ft WHEN 'ask_back' THEN CASE WHEN n_chunks > 0 THEN {lit(V.NEED_MORE)} || chr(10) || chr(10) || {lit(V.FOUND_IN)} || top_title || ':' || chr(10) || '"...' || substr(top_text, 1, 200) || CASE WHEN len(top_text) > 200 THEN '...' ELSE '' END || '..."' || chr(10) ELSE '' END || chr(10) || chr(10) || '❓ ' || fq
  WHEN 'cautious' THEN CASE WHEN {sql_strip('answer')} <> '' THEN {sql_strip('answer')} || chr(10) || chr(10) || CASE WHEN nc > 0 THEN {lit(V.SHORT_WARNING)} ELSE {lit(V.CAUTIOUS_WARNING)} END ELSE {lit(V.CAUTIOUS_PREFIX)} || chr(10) || chr(10) || {lit(V.CAUTIOUS_WARNING)} END
  WHEN 'abstain' THEN {lit(V.NO_INFO)} || chr(10) || chr(10) || {lit(V.RETRY_HINT)} ELSE answer END AS final_answer, CASE WHEN ft = 'none' THEN 'answer' ELSE ft END AS final_decision, ft <> 'none' AS applied FROM a""")
def fallback_render(spark, d):
    q = F.col("query_id")
    answer = F.when(q % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("query"), F.lit(" ")))
    decided = D.fallback(features(spark, d)).withColumns({"answer": answer, "n_citations": q % 2})
    return D.fallback_render(decided).select("query_id", "final_answer", "final_decision", "applied")


# ---- context ----------------------------------------------------------------

_SOURCE = "CASE WHEN chunk_id % 2 = 0 THEN 'same' ELSE van_ban END"


def with_sources(spark, d):
    """Ranked chunks, half of them of one document, some of one text."""
    text = F.when(F.col("chunk_id") % 7 == 0, F.lit("One Text")).otherwise(F.col("text"))
    source = F.when(F.col("chunk_id") % 2 == 0, F.lit("same")).otherwise(F.col("van_ban"))
    return scored(spark, d).withColumns({"text": text, "van_ban": source})


DIVERSE = f"""{I.BM25_RUN}, src AS (SELECT query_id, chunk_id, rank, CASE WHEN chunk_id % 7 = 0 THEN 'One Text' ELSE text END AS text, CASE WHEN chunk_id % 2 = 0 THEN 'same' ELSE source END AS van_ban, lang AS dieu FROM run JOIN documents ON doc_id = chunk_id WHERE query_id % 9 > 0),
keyed AS (SELECT *, substr(regexp_replace(lower(text), '[\\s\\p{{Z}}]+', '', 'g'), 1, 200) AS key, van_ban || '|' || dieu AS so FROM src),
steps AS (SELECT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS ks, []::VARCHAR[] AS ss, []::BIGINT[] AS acc FROM (SELECT DISTINCT query_id FROM keyed)
  UNION ALL SELECT query_id, rank, CASE WHEN ok THEN list_append(ks, key) ELSE ks END, CASE WHEN ok THEN list_append(ss, so) ELSE ss END, CASE WHEN ok THEN list_append(acc, chunk_id) ELSE acc END FROM (
    SELECT k.query_id, k.rank, ks, ss, acc, key, so, chunk_id, len(acc) < 5 AND NOT list_contains(ks, key) AND len(list_filter(ss, lambda x: x = so)) < 2 AS ok FROM steps s JOIN keyed k ON k.query_id = s.query_id AND k.rank = s.rank + 1)),
chosen AS (SELECT query_id, unnest(range(1, len(acc) + 1)) AS position, unnest(acc) AS chunk_id FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1))"""


@query("diversify", f"WITH RECURSIVE {DIVERSE} SELECT query_id, position, chunk_id, rank FROM chosen JOIN keyed USING (query_id, chunk_id)")
def diversify(spark, d):
    out = X.diversify(with_sources(spark, d))
    return out.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", F.col("rank").cast("long").alias("rank"))


_HEADS = "(?m)(?:^|\\n)\\s*(?:Điều|Khoản|Điểm)\\s+\\d+"
_AFTER = "substr(text, stop + 1, 250)"
_BEFORE = "substr(text, greatest(start - 250, 0) + 1, least(start, 250))"
SPAN_TRIM = f"""WITH {I.sql_keywords('benchmark', 'item_id', 'text')}, {I.BM25_RUN.removeprefix('WITH ')},
r AS (SELECT r.query_id, r.chunk_id, t.text, lower(t.text) AS low, k.words FROM run r JOIN documents t ON t.doc_id = r.chunk_id JOIN kw k ON k.item_id = r.query_id WHERE r.query_id % 9 > 0),
w AS (SELECT query_id, chunk_id, text, low, i AS wi, words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM r WHERE len(text) > 400)),
p AS (SELECT *, string_split(low, word) AS ps FROM w),
g AS (SELECT *, unnest(range(1, len(ps))) AS i FROM p),
h AS (SELECT query_id, chunk_id, text, wi, i, CAST(list_sum(list_transform(ps[1:i], lambda x: len(x))) + (i - 1) * len(word) AS BIGINT) AS start, len(word) AS n FROM g),
h2 AS (SELECT *, start + n AS stop FROM h),
s AS (SELECT query_id, chunk_id, text, wi, i,
    CAST(start - len(CASE WHEN contains({_BEFORE}, chr(10)) THEN string_split({_BEFORE}, chr(10))[-1] WHEN contains({_BEFORE}, '. ') THEN string_split({_BEFORE}, '. ')[-1] ELSE {_BEFORE} END) AS BIGINT) AS b,
    CAST(stop + CASE WHEN contains({_AFTER}, '.' || chr(10)) THEN strpos({_AFTER}, '.' || chr(10)) + 1 WHEN contains({_AFTER}, '. ') THEN strpos({_AFTER}, '. ') + 1 WHEN contains({_AFTER}, chr(10)) THEN strpos({_AFTER}, chr(10)) ELSE len({_AFTER}) END AS BIGINT) AS e FROM h2),
q AS (SELECT query_id, chunk_id, any_value(text) AS text, arg_min(b, (wi, i)) AS first, arg_max(e, (wi, i)) AS last FROM s GROUP BY ALL HAVING len(regexp_extract_all(any_value(text), '{_HEADS}')) > 0),
hd AS (SELECT query_id, chunk_id, text, first, last, CAST(list_sum(list_transform(string_split_regex(text, '{_HEADS}')[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{_HEADS}')[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '{_HEADS}')) + 1)) AS i FROM q)),
ends AS (SELECT *, min(pos) FILTER (WHERE pos > last) OVER (PARTITION BY query_id, chunk_id) AS stop FROM hd),
bl AS (SELECT query_id, chunk_id, any_value(text) AS text, coalesce(max(pos) FILTER (WHERE pos <= first AND (stop IS NULL OR pos <= stop)), 0) AS b, coalesce(any_value(stop), len(any_value(text))) AS e FROM ends GROUP BY query_id, chunk_id),
a AS (SELECT query_id, chunk_id, text, b, e FROM s UNION SELECT query_id, chunk_id, text, CAST(b AS BIGINT), CAST(e AS BIGINT) FROM bl WHERE e - b <= 800),
o AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY query_id, chunk_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM a),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, chunk_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT query_id, chunk_id, any_value(text) AS text, min(b) AS b, max(e) AS e FROM n GROUP BY query_id, chunk_id, island),
f AS (SELECT query_id, chunk_id, b, CASE WHEN b > 0 THEN '...' || regexp_replace(substr(text, b + 1, e - b), '^[\\s\\p{{Z}}]+', '') ELSE substr(text, b + 1, e - b) END AS part, e < len(text) AS cut FROM m),
t AS (SELECT query_id, chunk_id, string_agg(CASE WHEN cut THEN regexp_replace(part, '[\\s\\p{{Z}}]+$', '') || '...' ELSE part END, ' ' ORDER BY b) AS trimmed FROM f GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, coalesce(t.trimmed, r.text) AS trimmed FROM r LEFT JOIN t USING (query_id, chunk_id)"""


@query("span_trim", SPAN_TRIM)
def span_trim(spark, d):
    rows = scored(spark, d).join(I.queries(spark, d), "query_id")
    return X.trim_rows(rows.withColumn("keywords", K.keywords(F.col("query"), I.LEXICON)))


@query("interval_merge", """WITH e AS (SELECT user_id AS key, epoch(ts)::BIGINT AS start, epoch(ts)::BIGINT + CAST(floor(value * 60) AS BIGINT) AS stop FROM events),
a AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e),
b AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT key, min(start) AS start, max(stop) AS stop FROM b GROUP BY key, i""".replace("epoch(ts)::BIGINT", "(epoch_us(ts) // 1000000)"))
def interval_merge(spark, d):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), start.alias("start"), (start + F.floor(F.col("value") * 60).cast("long")).alias("stop"))
    return X.interval_merge(rows)


@query("context_assemble", f"""WITH RECURSIVE {DIVERSE}, x AS (SELECT query_id, position, '[' || position || '] [VB: ' || van_ban || ', Chương I, Điều ' || dieu || ', Khoản ' || (chunk_id % 7) || CASE WHEN chunk_id % 3 = 0 THEN ', Điểm a' ELSE '' END || ']' || chr(10) || text AS t FROM chosen JOIN keyed USING (query_id, chunk_id)),
y AS (SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY position) AS context, count(*) AS n_chunks FROM x GROUP BY query_id) SELECT *, CAST(floor(len(context) / 1.5::DOUBLE) AS BIGINT) AS tokens FROM y""")
def context_assemble(spark, d):
    rows = with_sources(spark, d)
    chosen = X.diversify(rows).select("query_id", "chunk_id", "position")
    return X.assemble(rows.join(chosen, ["query_id", "chunk_id"]))


@query("retrieval_context_rows", f"""WITH {I.BM25_RUN} SELECT query_id, rank, substr(text, 1, 500) AS text, round(score, 4) AS score_retrieval, round(score * ([1.0, 0.05, 0.01, 0.001]::DOUBLE[])[query_id % 4 + 1], 4) AS score_rerank, source AS van_ban, lang AS dieu,
  CAST(doc_id % 7 AS VARCHAR) AS khoan, CASE WHEN doc_id % 3 = 0 THEN 'a' END AS diem, chunk_id FROM run JOIN documents ON doc_id = chunk_id WHERE query_id % 9 > 0""")
def retrieval_context_rows(spark, d):
    out = X.display_rows(scored(spark, d).withColumnRenamed("score", "score_retrieval"))
    return out.withColumn("rank", F.col("rank").cast("long"))
