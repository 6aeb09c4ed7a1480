"""Queries over scalar functions."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions import citations as C
from statuta.functions import fixed_values as V
from statuta.functions import keywords as K
from statuta.functions import scores as S
from statuta.functions import text as T
from statuta.operators import answers as A
from statuta.plans import inputs as I
from statuta.plans.inputs import lit, sql_any, sql_case, sql_list, sql_strip, sql_words
from statuta.plans.registry import query
from statuta.sources.tables import table, text_table
from statuta.unfold import unfold

USERS = "users AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user')"


@query("vi_tokenize", f"""WITH t AS (SELECT doc_id, {I.sql_tokens('text')} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""")
def vi_tokenize(spark, d):
    toks = I.documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("normalise_keys", f"""SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) AS bare_md5, md5({I.sql_collapsed('text')}) AS collapsed_md5,
substr(regexp_replace(lower(text), '[\\s\\p{{Z}}]+', '', 'g'), 1, 200) AS dense_key, substr({I.sql_collapsed('text')}, 1, 500) AS collapsed_key FROM documents""")
def normalise_keys(spark, d):
    text = F.col("text")
    return I.documents(spark, d).select(
        "doc_id", F.md5(T.bare_key(text)).alias("bare_md5"), F.md5(T.collapsed(text)).alias("collapsed_md5"),
        T.dense_key(text).alias("dense_key"), T.collapsed_key(text).alias("collapsed_key"),
    )


@query("keyword_extract", f"""WITH {I.sql_keywords('benchmark', 'item_id', 'text')} SELECT item_id AS query_id, array_to_string(words, ',') AS keywords, CAST(len(words) AS BIGINT) AS n FROM kw""")
def keyword_extract(spark, d):
    kw = I.queries(spark, d).select("query_id", K.keywords(F.col("query"), I.LEXICON).alias("kw"))
    return kw.select("query_id", F.array_join("kw", ",").alias("keywords"), F.size("kw").cast("long").alias("n"))


def sql_query_type(low):
    parts = ", ".join(f"CASE WHEN {sql_any(low, marks)} THEN {lit(name)} END" for name, marks in I.LEXICON.query_types)
    return f"coalesce(nullif(concat_ws(',', {parts}), ''), 'general')"


@query("query_type", f"WITH {USERS} SELECT conv_id, turn, {sql_query_type('low')} AS query_type FROM users")
def query_type(spark, d):
    return I.turns(spark, d, "user").select("conv_id", "turn", K.query_type(F.col("text"), I.LEXICON).alias("query_type"))


def sql_clarification(low, text):
    cases = [(f"regexp_matches({low}, {lit(p)})", lit(q)) for p, q in I.LEXICON.clarify_patterns]
    cases += [(f"contains({low}, {lit(t)}) AND len({sql_words(text)}) < 10", lit(q)) for t, q in I.LEXICON.clarify_triggers]
    return sql_case(cases, "NULL")


@query("clarification_need", f"""WITH {USERS}, x AS (SELECT conv_id, turn, {sql_clarification('low', 'text')} AS question FROM users)
SELECT conv_id, turn, question IS NOT NULL AS needed, question FROM x""")
def clarification_need(spark, d):
    question = K.clarification(F.col("text"), I.LEXICON)
    return I.turns(spark, d, "user").select("conv_id", "turn", question.isNotNull().alias("needed"), question.alias("question"))


def sql_missing(low, text, what):
    cases = [
        (f"{sql_any(low, triggers)} AND NOT regexp_matches({low}, {lit(p)})", lit((kind, q)[what]))
        for kind, triggers, q, p in I.LEXICON.missing_info if p
    ]
    return sql_case([*cases, (f"len({sql_words(text)}) < 5", lit(("detail", V.DETAIL_QUESTION)[what]))], "NULL")


@query("missing_info_type", f"WITH {USERS} SELECT conv_id, turn, {sql_missing('low', 'text', 0)} AS kind, {sql_missing('low', 'text', 1)} AS question FROM users")
def missing_info_type(spark, d):
    found = I.turns(spark, d, "user").select("conv_id", "turn", K.missing_info(F.col("text"), I.LEXICON).alias("m"))
    return found.select("conv_id", "turn", "m.kind", "m.question")


def sql_gate_question(low, missing):
    lx = I.LEXICON
    subject = f"len(list_intersect({missing}, {sql_list(lx.subject_words)})) > 0"
    return sql_case(
        [(sql_any(low, lx.location_words), lit(V.LOCATION_QUESTION)), (sql_any(low, lx.time_words), lit(V.TIME_QUESTION)), (subject, lit(V.SUBJECT_QUESTION))],
        lit(V.DETAIL_QUESTION),
    )


def sql_generic_question(low):
    return sql_case([(sql_any(low, marks), lit(q)) for marks, q in I.LEXICON.generic_questions], lit(V.GENERIC_DEFAULT))


@query("clarification_text", f"""WITH {USERS} SELECT conv_id, turn, {sql_gate_question('low', "string_split(low, ' ')")} AS gate_question, {sql_generic_question('low')} AS generic_question FROM users""")
def clarification_text(spark, d):
    text = F.col("text")
    return I.turns(spark, d, "user").select(
        "conv_id", "turn", K.gate_question(text, F.split(F.lower(text), " "), I.LEXICON).alias("gate_question"),
        K.generic_question(text, I.LEXICON).alias("generic_question"),
    )


@query("token_estimate", """SELECT doc_id, CAST(floor(len(text) / 1.5::DOUBLE) AS BIGINT) AS tokens, floor(len(text) / 1.5::DOUBLE) <= 2048 AS valid,
CAST(greatest(0, floor(len(text) / 1.5::DOUBLE) - 2048) AS BIGINT) AS overflow FROM documents""")
def token_estimate(spark, d):
    t = F.col("tokens")
    return I.documents(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens")).select(
        "doc_id", "tokens", (t <= 2048).alias("valid"), F.greatest(F.lit(0), t - 2048).cast("long").alias("overflow")
    )


@query("citation_format", """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_partkey % 5 > 0 THEN CAST(l_orderkey AS VARCHAR) END AS d, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS k,
  CASE WHEN l_partkey % 2 > 0 THEN lower(l_returnflag) END AS p, CASE WHEN l_suppkey % 4 > 0 THEN 'NĐ ' || l_suppkey WHEN l_suppkey % 8 = 0 THEN 'N/A' ELSE '' END AS vb FROM lineitem),
y AS (SELECT *, coalesce(nullif(concat_ws(', ', 'Điều ' || d, CASE WHEN k <> '' THEN 'Khoản ' || k END, 'Điểm ' || p), ''), 'N/A') AS base FROM x)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, base AS citation, CASE WHEN vb = '' THEN base ELSE base || ' - ' || vb END AS full_citation,
  CASE WHEN vb IN ('', 'N/A') THEN base ELSE '**' || vb || '**: ' || base END AS display,
  concat_ws(', ', '[VB: ' || vb, 'Chương II', 'Điều ' || d, CASE WHEN k <> '' THEN 'Khoản ' || k END, 'Điểm ' || p) || ']' AS header FROM y""")
def citation_format(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    dieu = F.when(F.col("l_partkey") % 5 > 0, s("l_orderkey"))
    khoan = F.when(F.col("l_partkey") % 3 > 0, s("l_linenumber")).otherwise(F.lit(""))
    diem = F.when(F.col("l_partkey") % 2 > 0, F.lower("l_returnflag"))
    vb = (
        F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("NĐ "), s("l_suppkey")))
        .when(F.col("l_suppkey") % 8 == 0, F.lit("N/A")).otherwise(F.lit(""))
    )
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C.citation(dieu, khoan, diem).alias("citation"),
        C.full_citation(vb, dieu, khoan, diem).alias("full_citation"), C.display_citation(vb, dieu, khoan, diem).alias("display"),
        C.header(vb, F.lit("II"), dieu, khoan, diem).alias("header"),
    )


def sql_sigmoid(x):
    return f"(1 / (1 + exp(-greatest(-10.0::DOUBLE, least(10.0::DOUBLE, {x})))))"


@query("score_transforms", f"""WITH {I.BM25_RUN}, x AS (SELECT query_id, chunk_id, rank, score, score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) AS m FROM run)
SELECT query_id, chunk_id, round({sql_sigmoid('score')}, 6) AS sig, {I.sql_round('(m / greatest(abs(score), 1.0))')} AS norm_margin,
  round({sql_sigmoid('m / greatest(abs(score), 1.0) * 50 - 1.5')}, 6) AS confidence_raw, round({sql_sigmoid('m * 100 - 1.5')}, 6) AS confidence_sigmoid,
  round({sql_sigmoid('score / 5')}, 6) AS similarity_raw, round(score, 6) AS similarity_sigmoid FROM x""")
def score_transforms(spark, d):
    s, m = F.col("score"), F.col("m")
    nxt = F.coalesce(F.lead("score").over(W.partitionBy("query_id").orderBy("rank")), F.lit(0.0))
    x = I.bm25_run(spark, d).withColumn("m", s - nxt)
    no, yes = F.lit(False), F.lit(True)
    shown = {
        "sig": S.sigmoid(s), "norm_margin": S.normalised_margin(s, m),
        "confidence_raw": S.confidence(s, m, F.lit(50.0), no), "confidence_sigmoid": S.confidence(s, m, F.lit(100.0), yes),
        "similarity_raw": S.similarity(s, no), "similarity_sigmoid": S.similarity(s, yes),
    }
    return x.select("query_id", "chunk_id", *[F.round(c, 6).alias(n) for n, c in shown.items()])


@query("answer_json_parse", f"""WITH {I.ANSWERS} SELECT answer_id, CASE kind WHEN 4 THEN 'r' || num WHEN 5 THEN 'f' || num WHEN 1 THEN txt WHEN 2 THEN txt WHEN 3 THEN txt END AS answer,
  CASE WHEN kind IN (1, 2) THEN 'vb' || num || '|' || num || '|2|q' ELSE '' END AS citations, kind IN (4, 5) AS abstain, kind IN (1, 2, 3, 4, 5) AS is_json,
  CASE kind WHEN 4 THEN 'r' || num WHEN 5 THEN 'f' || num END AS reason FROM answers""")
def answer_json_parse(spark, d):
    a = I.answers(spark, d).select("answer_id", C.parsed_answer(F.col("raw")).alias("a"))
    cites = F.array_join(
        F.transform("a.citations", lambda c: F.concat_ws("|", c["van_ban"], c["dieu"], c["khoan"], c["diem"], c["quoted_text"])), ";"
    )
    return a.select("answer_id", "a.answer", cites.alias("citations"), "a.abstain", "a.is_json", "a.reason")


def cited_texts(spark, d):
    """One text per order line with up to three article mentions at varying distances."""
    s = lambda c: F.col(c).cast("string")
    gap = lambda n: F.repeat(F.lit("xin chào "), n)
    li = text_table(spark, d, "lineitem")
    one = F.concat(F.lit("Theo khoản "), s("l_linenumber"), F.lit(" điểm "), F.lower("l_returnflag"), F.lit(" "), gap(F.col("l_linenumber")), F.lit("Điều "), s("l_suppkey"))
    two = F.concat(gap((F.col("l_partkey") % 17).cast("int")), F.lit(" và điều số "), (F.col("l_partkey") % 90).cast("string"), F.lit("a "), gap((F.col("l_suppkey") % 13).cast("int")), F.lit("Khoản số 4, Điểm đ"))
    none = F.concat(F.lit("Khoản 3 rồi khoản "), s("l_linenumber"), F.lit(" và khoản 3"))
    kind = F.col("l_orderkey") % 4
    text = F.when(kind == 0, none).when(kind == 1, one).when(kind == 2, F.concat(one, two)).otherwise(F.concat(one, two, F.lit(" hết. "), one))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.alias("text"))


_ONE = "'Theo khoản ' || l_linenumber || ' điểm ' || lower(l_returnflag) || ' ' || repeat('xin chào ', l_linenumber) || 'Điều ' || l_suppkey"
_TWO = "repeat('xin chào ', l_partkey % 17) || ' và điều số ' || (l_partkey % 90) || 'a ' || repeat('xin chào ', l_suppkey % 13) || 'Khoản số 4, Điểm đ'"
CITED = f"""cited AS (SELECT row_number() OVER () AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'Khoản 3 rồi khoản ' || l_linenumber || ' và khoản 3'
  WHEN 1 THEN {_ONE} WHEN 2 THEN {_ONE} || {_TWO} ELSE {_ONE} || {_TWO} || ' hết. ' || {_ONE} END AS text FROM lineitem)"""


@query("citation_extract", f"""WITH {CITED},
m AS (SELECT *, regexp_extract_all(text, {lit(V.ARTICLE_CITE)}) AS ms, regexp_extract_all(text, {lit(V.ARTICLE_CITE)}, 1) AS ns, string_split_regex(text, {lit(V.ARTICLE_CITE)}) AS gs FROM cited),
u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT *, list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: len(g))), 0) AS b FROM u),
w AS (SELECT *, substr(text, CAST(greatest(0, b - 60) + 1 AS BIGINT), CAST(b + len(ms[i]) + 100 - greatest(0, b - 60) AS BIGINT)) AS near FROM p),
t AS (SELECT DISTINCT id, ns[i] AS dieu, nullif(regexp_extract(near, {lit(V.CLAUSE_CITE)}, 1), '') AS khoan, nullif(regexp_extract(near, {lit(V.POINT_CITE)}, 1), '') AS diem FROM w
  UNION ALL SELECT DISTINCT id, NULL, unnest(regexp_extract_all(text, {lit(V.CLAUSE_CITE)}, 1)), NULL FROM m WHERE len(ms) = 0)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, dieu, khoan, diem FROM t JOIN cited USING (id)""")
def citation_extract(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return unfold(cited_texts(spark, d), keys, C.extracted(F.col("text")), "c").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "c.dieu", "c.khoan", "c.diem"
    )


@query("abstain_detect", f"""WITH {I.ANSWERS}, x AS (SELECT answer_id, CASE WHEN kind = 3 THEN ' [Abstain] ' WHEN kind = 2 THEN raw || ' not found' ELSE raw END AS t FROM answers),
y AS (SELECT answer_id, {sql_strip('lower(t)')} AS low FROM x)
SELECT answer_id, low = '' OR list_contains({sql_list(V.REFUSALS)}, low) OR (len(low) < 200 AND {sql_any('low', V.ABSTAIN_MARKERS)}) AS abstain FROM y""")
def abstain_detect(spark, d):
    raw = F.col("raw")
    text = F.when(F.col("kind") == 3, F.lit(" [Abstain] ")).when(F.col("kind") == 2, F.concat(raw, F.lit(" not found"))).otherwise(raw)
    return I.answers(spark, d).select("answer_id", C.abstained(text).alias("abstain"))


@query("conclusion_extract", f"""WITH {I.ANSWERS} SELECT answer_id, CASE WHEN kind IN (0, 6) THEN {sql_strip('txt')}
  WHEN regexp_matches(raw, {lit(V.CONCLUSION_PATTERN)}) THEN {sql_strip("regexp_extract(regexp_replace(raw, '^[:\\s" + chr(34) + "]+', ''), " + lit(V.CONCLUSION_PATTERN) + ", 1)")} ELSE regexp_replace({sql_strip('raw')}, '^[:\\s"]+', '') END AS conclusion FROM answers""")
def conclusion_extract(spark, d):
    a = I.answers(spark, d)
    prefixed = F.when(F.col("kind") == 0, F.concat(F.lit(' : "'), "txt", F.lit("\n Căn cứ pháp lý \nĐiều 1"))).otherwise(F.col("raw"))
    return a.select("answer_id", C.conclusion(prefixed).alias("conclusion"))


@query("title_from_message", """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Kept' ELSE substr(t, 1, 80) || CASE WHEN len(t) > 80 THEN '...' ELSE '' END END AS title
FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def title_from_message(spark, d):
    title = F.when(F.col("conv_id") % 3 == 0, F.lit("Kept")).otherwise(F.lit(V.DEFAULT_CHAT_TITLE))
    return A.chat_title(table(spark, d, "conversations").withColumn("title", title))


@query("l2_normalise", f"""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE * 3) END AS v FROM embeddings),
y AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM x)
SELECT vec_id, i - 1 AS pos, {I.sql_round('(CASE WHEN n > 0 THEN v[i] / n ELSE v[i] END)')} AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM y)""")
def l2_normalise(spark, d):
    scale = F.when(F.col("vec_id") % 50 == 0, F.lit(0.0)).otherwise(F.lit(3.0))
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    return e.select("vec_id", F.posexplode(S.unit(F.col("v"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


@query("mean_pool", f"""WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label), a AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM a GROUP BY label)
SELECT label, pos, {I.sql_round('(CASE WHEN k > 1 AND n > 0 THEN x / n ELSE x END)')} AS value FROM a JOIN n USING (label) JOIN c USING (label)""")
def mean_pool(spark, d):
    from statuta.operators.vectors import mean_pool as pool

    pooled = pool(table(spark, d, "embeddings").select(F.col("label").alias("key"), "embedding"))
    return pooled.select(F.col("key").alias("label"), F.posexplode("embedding").alias("pos", "value")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


_SYSTEM = "S" * 120
_LIMIT = int((1200 - 300 - 100) * 1.5)
_TAIL = "'## CÂU HỎI:' || chr(10) || q || chr(10) || chr(10) || " + lit(V.PROMPT_REQUIREMENTS + V.PROMPT_JSON)


@query("prompt_table", f"""WITH x AS (SELECT doc_id, text AS q, text AS c, CASE WHEN doc_id % 10 = 0 THEN repeat('S', 1100) ELSE {lit(_SYSTEM)} END AS s FROM documents),
y AS (SELECT *, {lit(V.PROMPT_CONTEXT)} || c || chr(10) || chr(10) AS head, {_TAIL} AS tail, {_LIMIT} - len(s) AS room FROM x),
z AS (SELECT *, len(s) + len(head) + len(tail) > {_LIMIT} AS over, CASE WHEN room < 200 THEN {_LIMIT // 2} ELSE room END AS n FROM y)
SELECT doc_id, CASE WHEN over AND room < 200 THEN substr(s, 1, {_LIMIT // 2}) ELSE s END AS system,
  CASE WHEN NOT over OR len(head) + len(tail) <= n THEN head || tail WHEN n - len(tail) > 100 THEN substr(head, 1, n - len(tail)) || {lit(V.PROMPT_CUT)} || tail
  ELSE substr(head || tail, 1, n) END AS prompt FROM z""")
def prompt_table(spark, d):
    docs = I.documents(spark, d)
    system = F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("S"), 1100)).otherwise(F.lit(_SYSTEM))
    prompt = A.user_prompt(F.col("text"), F.col("text"))
    out = docs.select("doc_id", prompt.alias("p"), system.alias("s")).select("doc_id", A.fitted(F.col("p"), F.col("s"), 1200, 300).alias("x"))
    return out.select("doc_id", "x.prompt", "x.system")
