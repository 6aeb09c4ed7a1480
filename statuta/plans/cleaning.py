"""Queries over page and text cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions import text as T
from statuta.operators import cleaning as C
from statuta.operators import boosts as B
from statuta.plans import inputs as I
from statuta.plans.inputs import lit, sql_any, sql_list, sql_strip, sql_words
from statuta.plans.registry import query
from statuta.sources.tables import table


def pages_of(docs):
    """Documents as pages of ten lines."""
    lines = F.split("text", "\n")
    n = F.ceil(F.size("lines") / 10).cast("int")
    return docs.select("doc_id", lines.alias("lines")).select(
        "doc_id", "lines", F.explode(F.sequence(F.lit(1), n)).alias("p")
    ).select(
        "doc_id",
        F.concat(F.lit("page_"), F.col("p").cast("string")).alias("page_key"),
        F.array_join(F.slice("lines", (F.col("p") - 1) * 10 + 1, F.lit(10)), "\n").alias("text"),
    )


PAGES = """pages_of AS (SELECT doc_id, p, array_to_string(ls[(p - 1) * 10 + 1 : p * 10], chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, CAST(ceil(len(string_split(text, chr(10))) / 10) AS BIGINT) + 1)) AS p FROM documents))"""


@query("page_merge", f"""WITH {PAGES},
x AS (SELECT doc_id, p, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}),
   lambda l: NOT regexp_matches(l, '^[0-9]+$') AND len(l) >= 2 AND NOT regexp_matches(l, {lit(V.PAGE_NOISE)})) AS ls FROM pages_of WHERE text <> '')
SELECT doc_id, string_agg(chr(10) || '[PAGE_' || p || ']' || chr(10) || array_to_string(ls, chr(10)), chr(10) || chr(10) ORDER BY p) AS text, count(*) AS n_pages
FROM x GROUP BY doc_id""")
def page_merge(spark, d):
    return C.merge_pages(pages_of(I.documents(spark, d)))


@query("reading_order", """SELECT l_orderkey AS page_id, string_agg(t, chr(10) ORDER BY l_linenumber, l_extendedprice, t) AS text
FROM (SELECT *, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE l_returnflag || l_partkey END AS t FROM lineitem) WHERE t <> '' GROUP BY l_orderkey""")
def reading_order(spark, d):
    text = F.when(F.col("l_partkey") % 10 == 0, F.lit("")).otherwise(
        F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    )
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("y"), F.col("l_extendedprice").alias("x"), text.alias("text")
    )
    return C.reading_order(boxes)


_SPOILT = [(". ", ".\nl. "), ("tion", "C0NG|"), (" of ", " S0 "), ("und", "Diêu"), ("la ", "xa hoi-\n ")]


def _sql_repaired():
    out = "text"
    for a, b in _SPOILT:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    out = f"regexp_replace({out}, '\\n[lI]\\.\\s', chr(10) || '1. ', 'g')"
    out = f"regexp_replace({out}, '\\bS0\\b', 'SỐ', 'g')"
    for a, b in V.OCR_REPLACEMENTS:
        out = f"replace(replace({out}, {lit(a)}, {lit(b)}), {lit(a.lower())}, {lit(b.lower())})"
    return f"regexp_replace(regexp_replace({out}, '[|¬~`]', '', 'g'), '-\\s*\\n\\s*', '', 'g')"


@query("ocr_repair", f"SELECT doc_id, {_sql_repaired()} AS text FROM documents")
def ocr_repair(spark, d):
    spoilt = F.col("text")
    for a, b in _SPOILT:
        spoilt = F.replace(spoilt, F.lit(a), F.lit(b))
    return I.documents(spark, d).select("doc_id", T.repaired(spoilt).alias("text"))


@query("correction_guard", f"""WITH x AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(text, 'e', 'eeee') WHEN 1 THEN replace(text, 'e', 'é') ELSE substr(text, 1, 60) END || ' ' AS fixed FROM documents)
SELECT doc_id, CASE WHEN len({sql_words('text')}) > 3 AND len({sql_words('text')}) <= 400 AND len({sql_strip('text')}) >= 3
  AND len(fixed) >= len(text) * 0.5::DOUBLE AND len(fixed) <= len(text) * 1.5::DOUBLE THEN {sql_strip('fixed')} ELSE text END AS text FROM x""")
def correction_guard(spark, d):
    kind = F.col("doc_id") % 3
    fixed = (
        F.when(kind == 0, F.replace("text", F.lit("e"), F.lit("eeee")))
        .when(kind == 1, F.replace("text", F.lit("e"), F.lit("é")))
        .otherwise(F.substring("text", 1, 60))
    )
    docs = I.documents(spark, d).withColumn("fixed", F.concat(fixed, F.lit(" ")))
    return docs.select("doc_id", T.guarded(F.col("text"), F.col("fixed")).alias("text"))


@query("whitespace_normalise", f"""SELECT doc_id, {sql_strip("replace(replace(replace(t, chr(13), ''), '  ', ' '), chr(10) || chr(10), chr(10))")} AS text
FROM (SELECT doc_id, replace(replace(text, '. ', '.   '), 'e' || chr(10), 'e' || chr(13) || chr(10) || chr(10)) AS t FROM documents)""")
def whitespace_normalise(spark, d):
    loose = F.replace(F.replace("text", F.lit(". "), F.lit(".   ")), F.lit("e\n"), F.lit("e\r\n\n"))
    return I.documents(spark, d).select("doc_id", T.single_pass_spaces(loose).alias("text"))


def _sql_tidied(x):
    out = f"regexp_replace({sql_strip('regexp_replace(' + x + chr(44) + ' ' + lit('[' + chr(92) + 's' + chr(92) + 'p{Z}]+') + chr(44) + ' ' + lit(' ') + chr(44) + ' ' + lit('g') + ')')}, '\\s+([,.;:!?])', '\\1', 'g')"
    for p in ",.;:!?":
        out = f"regexp_replace({out}, '[{p}]\\s*[{p}]+', '{p}', 'g')"
    out = f"regexp_replace({out}, '\\s+([;:])', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g')"


@query("strip_title", f"""WITH x AS (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:3], ' ') AS title FROM documents),
y AS (SELECT *, text <> '' AND title <> '' AND contains(text, title) AND doc_id % 5 > 0 AS held FROM x)
SELECT doc_id, CASE WHEN held THEN {_sql_tidied("replace(text, title, '')")} ELSE text END AS text, held AS changed,
  CAST(count(*) FILTER (held) OVER () AS BIGINT) AS total_changed FROM y""")
def strip_title(spark, d):
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    title = F.when(F.col("doc_id") % 5 == 0, F.lit("no such title")).otherwise(first)
    docs = I.documents(spark, d).withColumn("title", title)
    text, held = T.without_title(F.col("text"), F.col("title"))
    total = docs.agg(F.count_if(held)).scalar()
    return docs.select("doc_id", text.alias("text"), held.alias("changed")).withColumn("total_changed", total)


@query("metadata_normalise", """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS khoan,
CAST(l_orderkey AS VARCHAR) AS dieu FROM lineitem""")
def metadata_normalise(spark, d):
    khoan = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" ")))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.trim(F.coalesce(khoan, F.lit(""))).alias("khoan"), F.trim(F.col("l_orderkey").cast("string")).alias("dieu")
    )


_TERMS = ["the on", "in the", "that", "under", "und die", "la que", "nicht"]


@query("legal_text_gate", f"""WITH x AS (SELECT doc_id, text, list_filter({sql_list(_TERMS)}, lambda t: contains(lower(text), t)) AS f FROM documents)
SELECT doc_id, array_to_string(f, ',') AS found, CASE WHEN len(text) < 500 THEN 'too_short' WHEN len(f) < 2 THEN 'too_few_terms' ELSE 'accepted' END AS status,
  NOT contains(text, '[PAGE_') AS no_page_marker FROM x""")
def legal_text_gate(spark, d):
    out = C.text_gate(I.documents(spark, d), _TERMS)
    return out.select("doc_id", F.array_join("found", ",").alias("found"), "status", "no_page_marker")


def headers(spark, d):
    """One header per order: issuing body, country line, motto, number, date, type."""
    o = table(spark, d, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    body = F.concat(F.lit("BỘ "), "o_orderpriority")
    between = F.when(key % 3 == 0, F.lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\n")).when(key % 3 == 1, F.lit("Email: x\n")).otherwise("")
    kind = F.element_at(F.array(F.lit("Nghị định"), F.lit("THÔNG TƯ"), F.lit("Quy tắc"), F.lit("Chỉ thị theo LUẬT")), (key % 4 + 1).cast("int"))
    text = F.concat(
        body, F.lit("\n"), between, F.lit("Độc lập - Tự do\nSố: "), key.cast("string"), F.lit("/ABC\nHà Nội, ngày "),
        F.dayofmonth(day).cast("string"), F.lit(" tháng "), F.month(day).cast("string"), F.lit(" năm "), F.year(day).cast("string"),
        F.lit("\n"), kind, F.lit("\nCHÍNH PHỦ "), F.col("o_custkey").cast("string"),
        F.lit("\nsố: "), F.col("o_custkey").cast("string"), F.lit("/X-1 end"),
    )
    return o.select("o_orderkey", text.alias("text"))


_DATE = "day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)"


@query("doc_metadata_extract", f"""SELECT o_orderkey, o_orderkey || '/ABC' AS so_hieu, {_DATE} AS ngay_ban_hanh,
CASE o_orderkey % 4 WHEN 0 THEN 'NGHỊ ĐỊNH' WHEN 1 THEN 'THÔNG TƯ' WHEN 2 THEN '' ELSE 'LUẬT' END AS loai_van_ban, 'BỘ ' || o_orderpriority AS co_quan_ban_hanh FROM orders""")
def doc_metadata_extract(spark, d):
    return headers(spark, d).select("o_orderkey", C.document_metadata(F.col("text")).alias("m")).select("o_orderkey", "m.*")


@query("header_metadata_v2", f"""SELECT o_orderkey, o_custkey || '/X-1' AS so_hieu, {_DATE} AS ngay_ban_hanh,
CASE o_orderkey % 4 WHEN 0 THEN 'Nghị định' WHEN 1 THEN 'THÔNG TƯ' WHEN 2 THEN '' ELSE 'LUẬT' END AS loai_van_ban, 'CHÍNH PHỦ ' || o_custkey AS co_quan_ban_hanh FROM orders""")
def header_metadata_v2(spark, d):
    return headers(spark, d).select("o_orderkey", C.header_metadata_v2(F.col("text")).alias("m")).select("o_orderkey", "m.*")


_ALLOWED = V.ALLOWED_CHARS.replace('\\"', '"')


@query("noise_flags", f"""WITH x AS (SELECT doc_id, {sql_strip('text')} AS t FROM documents)
SELECT doc_id, contains(t, '�') AS has_replacement, contains(t, '□') AS has_box, contains(t, '@@@') AS has_at,
  len(regexp_replace(t, {lit('[' + _ALLOWED + ']')}, '', 'g')) > greatest(20.0, len(t) * 0.05::DOUBLE) AS is_weird FROM x""")
def noise_flags(spark, d):
    return C.noise_flags(I.documents(spark, d)).select("doc_id", "has_replacement", "has_box", "has_at", "is_weird")


_IN, _OUT = ["tion", "heit", "que la"], ["the", "und ", "le "]


@query("scope_filter", f"""WITH x AS (SELECT conv_id, turn, {I.sql_collapsed('text')} AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN q = '' THEN true WHEN {sql_any('q', _IN)} THEN false ELSE {sql_any('q', _OUT)} END AS out_of_scope FROM x""")
def scope_filter(spark, d):
    return I.turns(spark, d, "user").select("conv_id", "turn", C.out_of_scope(F.col("text"), _IN, _OUT).alias("out_of_scope"))


@query("candidate_prefix_dedup", f"""WITH {I.RRF_RUN}, x AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, substr(text, 1, 200) ORDER BY rank) AS n
  FROM run JOIN documents ON doc_id = chunk_id) SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM x WHERE n = 1""")
def candidate_prefix_dedup(spark, d):
    run = I.rrf_run(spark, d)
    with_text = B.with_text(run, I.chunks(spark, d), run.count())
    return B.prefix_dedup(with_text).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("policy_violations", f"""WITH {I.ANSWERS} SELECT answer_id, txt AS answer FROM answers
WHERE txt <> '' AND kind NOT IN (1, 2, 4, 5, 7)""")
def policy_violations(spark, d):
    a = I.answers(spark, d).withColumn("abstain", F.col("kind").isin(4, 5, 7)).withColumn(
        "n_citations", F.when(F.col("kind").isin(1, 2), 1).otherwise(0)
    )
    return a.filter(C.policy_violation(F.col("txt"), F.col("abstain"), F.col("n_citations"))).select("answer_id", F.col("txt").alias("answer"))


@query("answer_quality_gate", f"""WITH {I.ANSWERS}, x AS (SELECT *, CASE kind WHEN 0 THEN substr(txt, 1, 15) WHEN 1 THEN txt || '[Placeholder]' ELSE txt END AS a,
  CASE WHEN kind = 2 THEN 'timeout ' || txt ELSE '' END AS error FROM answers),
y AS (SELECT answer_id, CASE WHEN error <> '' THEN 'error: ' || substr(error, 1, 60) WHEN len({sql_strip('a')}) < 20 THEN 'answer empty/too short'
  WHEN contains(a, '[Placeholder]') THEN 'placeholder response' WHEN kind <> 4 AND kind <> 3 THEN 'no citations' END AS reason FROM x)
SELECT answer_id, reason IS NOT NULL AS escalate, reason FROM y""")
def answer_quality_gate(spark, d):
    kind = F.col("kind")
    a = I.answers(spark, d)
    answer = F.when(kind == 0, F.left("txt", F.lit(15))).when(kind == 1, F.concat("txt", F.lit("[Placeholder]"))).otherwise(F.col("txt"))
    error = F.when(kind == 2, F.concat(F.lit("timeout "), "txt")).otherwise("")
    a = a.withColumn("answer", answer).withColumn("error", error)
    reason = C.escalation(F.col("answer"), kind == 4, F.when(kind == 3, 1).otherwise(0), F.col("error"))
    return a.select("answer_id", reason.isNotNull().alias("escalate"), reason.alias("reason"))
