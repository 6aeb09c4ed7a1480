"""Inputs of the registered queries, derived from the given tables, and the same in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.keywords import Lexicon
from statuta.operators import retrieval as R
from statuta.operators.boosts import Boosts, Topic
from statuta.session import stored
from statuta.sources.tables import table, text_table

# ---- tables -----------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.col("source").alias("van_ban"),
        F.lit("I").alias("chuong"),
        F.col("lang").alias("dieu"),
        (F.col("doc_id") % 7).cast("string").alias("khoan"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("a")).alias("diem"),
        F.concat(F.col("source"), F.lit(".pdf")).alias("source_file"),
        (F.col("doc_id") % 11 + 1).alias("page_number"),
    )


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return e.join(q, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Document d has the vector of number d mod the count of vectors."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*")).scalar()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    return docs.withColumn("vec_id", F.col("chunk_id") % n).join(e, "vec_id").select("chunk_id", "embedding")


def turns(spark: SparkSession, d: str, role: str) -> DataFrame:
    return text_table(spark, d, "conversations").filter(F.col("role") == role).select("conv_id", "turn", "text")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers of eight kinds: plain, JSON in several wrappings, refusals."""
    n = F.col("conv_id") + F.col("turn")
    txt = F.regexp_replace("text", r'["\\{}`\p{C}]', " ")
    num = (n % 50 + 1).cast("string")
    cite = lambda sep: F.concat(
        F.lit('{"van_ban": "vb'), num, F.lit('", "dieu": "'), num, F.lit('", "khoan": 2, "diem": null, "noi_dung": "q"}')
    )
    kinds = [
        txt,
        F.concat(F.lit('```json\n{"answer": "'), txt, F.lit('", "citations": ['), cite(""), F.lit('], "abstain": false}\n```')),
        F.concat(F.lit('See {"ket_luan": "'), txt, F.lit('", "trich_dan": '), cite(""), F.lit("} end")),
        F.concat(F.lit('"tra_loi": "'), txt, F.lit('", "citations": []}')),
        F.concat(F.lit('{"abstain": true, "reason": "r'), num, F.lit('"}')),
        F.concat(F.lit('{"refusal": "f'), num, F.lit('"}')),
        F.concat(F.lit("Intro\n**Kết luận**: "), txt, F.lit("\n\nTrích dẫn\nĐiều "), num, F.lit(" khoản 2")),
        F.concat(F.lit("Xin lỗi, không tìm thấy "), num),
    ]
    raw = F.element_at(F.array(*kinds), (n % 8 + 1).cast("int"))
    return turns(spark, d, "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), (n % 8).alias("kind"), txt.alias("txt"), num.alias("num"), raw.alias("raw")
    )


# ---- word lists for the synthetic texts (English, German, French) ------------

LEXICON = Lexicon(
    compounds=["of the", "that the", "is the", "in der", "der die", "de la", "que la", "the on"],
    stopwords=["the", "of", "and", "is", "der", "die", "und", "le", "la", "de"],
    query_types=[
        ("definition", ["that", "is "]),
        ("condition", ["when", "wenn"]),
        ("procedure", ["ver", "er "]),
        ("deadline", ["jour", "day"]),
    ],
    clarify_patterns=[
        (r"^(?:who|what|the)\??$", "Q-short"),
        (r"(?:^|\P{L})that the(?:\P{L}|$)", "Q-that"),
        (r"(?:^|\P{L})une(?:\P{L}|$)", "Q-une"),
    ],
    clarify_triggers=[("tion", "Q-tion"), ("heit", "Q-heit"), ("ment", "Q-ment")],
    missing_info=[
        ("location", ["la ", "from"], "M-location", r"(?:^|\P{L})(paris|the on)(?:\P{L}|$)"),
        ("time", ["jour", "tion"], "M-time", r"(?:^|\P{L})(and the|une)(?:\P{L}|$)"),
        ("subject", ["who", "und"], "M-subject", r"(?:^|\P{L})(ist|sich)(?:\P{L}|$)"),
        ("case", ["der"], "M-case", None),
    ],
    location_words=["from the", "paris"],
    time_words=["jour", "when"],
    subject_words=["ou", "und", "er"],
    fallback_stopwords=["the", "of", "and", "der", "die", "le", "la"],
    generic_questions=[(["tion", "sich"], "G-tion"), (["heit", "une "], "G-heit"), (["that", "how"], "G-that")],
)

BOOSTS = Boosts(
    topics=(
        Topic("first", [["that", "und"], ["tion", "ung"]], [("of the", 0.12), ("that the", 0.10), ("der die", 0.08)], ["idiot", "loser"]),
        Topic("second", [["une", "which"]], [("de la", 0.12), ("que la", 0.06)], ["que la la"]),
    ),
    places=("heat", "onen", "pour", "auf", "thin"),
    merger=Topic("merger", [["ention", "eron", "heit"]], [("the on", 0.25), ("is the", 0.18)]),
    source="was the",
    group_place="thin",
    group=("thin", "heat", "the on"),
)

# ---- SQL fragments ----------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def sql_any(column: str, phrases) -> str:
    return "(" + (" OR ".join(f"contains({column}, {lit(p)})" for p in phrases) or "false") + ")"


def sql_all(column: str, phrases) -> str:
    return "(" + " AND ".join(f"contains({column}, {lit(p)})" for p in phrases) + ")"


def sql_round(x: str, places: int = 6) -> str:
    """Rounded, where what rounds to nothing is a plain zero, without a sign."""
    return f"CASE WHEN abs({x}) < {0.5 * 10 ** -places:.1e} THEN 0.0::DOUBLE ELSE round({x}, {places}) END"


def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def sql_tokens(column: str) -> str:
    found = f"regexp_extract_all(lower({column}), {lit(V.VI_TOKEN_PATTERN)})"
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE {sql_words(f'lower({column})')} END)"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_collapsed(column: str) -> str:
    return f"regexp_replace(lower({sql_strip(f'coalesce({column}, {lit(str())})')}), '[\\s\\p{{Z}}]+', ' ', 'g')"


def sql_unique(expr: str) -> str:
    """First occurrences of a list, in order; ``expr`` should be a column."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def sql_case(cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + f" ELSE {default} END"


def sql_keywords(source: str, key: str, text: str, name: str = "kw") -> str:
    """CTEs giving ``name``(key, words): the keywords of ``text`` with the test lexicon."""
    lx = LEXICON
    return f"""{name}_a AS (SELECT {key}, lower({text}) AS low FROM {source}),
{name}_b AS (SELECT {key}, list_filter({sql_list(lx.compounds)}, lambda c: contains(low, c)) AS found,
  regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+') AS runs FROM {name}_a),
{name}_c AS (SELECT {key}, found, flatten(list_transform(found, lambda c: string_split(c, ' '))) AS inside,
  list_filter(runs, lambda w, i: list_position(runs, w) = i AND len(w) >= 2 AND NOT list_contains({sql_list(lx.stopwords)}, w)) AS single FROM {name}_b),
{name} AS (SELECT {key}, list_concat(found, list_filter(single, lambda w: NOT list_contains(inside, w) AND NOT list_contains(found, w))) AS words FROM {name}_c)"""


CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text, source AS van_ban, 'I' AS chuong, lang AS dieu, CAST(doc_id % 7 AS VARCHAR) AS khoan,
         CASE WHEN doc_id % 3 = 0 THEN 'a' END AS diem, source || '.pdf' AS source_file, doc_id % 11 + 1 AS page_number
  FROM documents)"""
ANSWERS = """answers AS (SELECT *, CASE kind WHEN 0 THEN txt
    WHEN 1 THEN '```json' || chr(10) || '{"answer": "' || txt || '", "citations": [{"van_ban": "vb' || num || '", "dieu": "' || num || '", "khoan": 2, "diem": null, "noi_dung": "q"}], "abstain": false}' || chr(10) || '```'
    WHEN 2 THEN 'See {"ket_luan": "' || txt || '", "trich_dan": {"van_ban": "vb' || num || '", "dieu": "' || num || '", "khoan": 2, "diem": null, "noi_dung": "q"}} end'
    WHEN 3 THEN '"tra_loi": "' || txt || '", "citations": []}' WHEN 4 THEN '{"abstain": true, "reason": "r' || num || '"}'
    WHEN 5 THEN '{"refusal": "f' || num || '"}'
    WHEN 6 THEN 'Intro' || chr(10) || '**Kết luận**: ' || txt || chr(10) || chr(10) || 'Trích dẫn' || chr(10) || 'Điều ' || num || ' khoản 2'
    ELSE 'Xin lỗi, không tìm thấy ' || num END AS raw
  FROM (SELECT conv_id * 1000 + turn AS answer_id, (conv_id + turn) % 8 AS kind, CAST((conv_id + turn) % 50 + 1 AS VARCHAR) AS num,
        regexp_replace(text, '["\\\\{}`\\p{C}]', ' ', 'g') AS txt FROM conversations WHERE role = 'assistant'))"""
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)"

BM25 = f"""ctok AS (SELECT doc_id AS chunk_id, {sql_tokens('text')} AS toks FROM documents),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM ctok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM ctok),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
bm25_all AS (
  SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN dfs USING (term) JOIN tf USING (term), corpus GROUP BY ALL),
bm25 AS (SELECT *, {_RANK} AS rank FROM bm25_all)"""

_GRAMS = """list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"""
TFIDF = f"""g AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_GRAMS}) AS term
       FROM (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents)) GROUP BY ALL),
gn AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM g GROUP BY term), gn
        WHERE df >= 2 AND df <= 0.9 * n),
gw AS (SELECT chunk_id, term, (1 + ln(tf)) * idf AS w FROM g JOIN voc USING (term)),
gnorm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM gw GROUP BY ALL),
qg AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_GRAMS}) AS term
       FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM benchmark)) GROUP BY ALL),
qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS qw FROM qg JOIN voc USING (term)),
qnorm AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY ALL),
tfidf_all AS (SELECT query_id, chunk_id, dot / norm / qn AS score FROM
  (SELECT query_id, chunk_id, sum(w * qw) AS dot FROM qw JOIN gw USING (term) GROUP BY ALL) JOIN gnorm USING (chunk_id) JOIN qnorm USING (query_id)),
tfidf AS (SELECT *, {_RANK} AS rank FROM tfidf_all)"""

DENSE = f"""dense_all AS (
  SELECT q.vec_id AS query_id, doc_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM documents JOIN embeddings v ON v.vec_id = doc_id % (SELECT count(*) FROM embeddings),
       embeddings q SEMI JOIN benchmark b ON q.vec_id = b.item_id),
dense AS (SELECT query_id, chunk_id, round(score, 9) AS score, {_RANK} AS rank FROM dense_all)"""


def sql_rrf(k: int, name: str = "rrf") -> str:
    """Fusion of the first ``k`` of bm25 and dense."""
    return f"""{name} AS (SELECT *, {_RANK} AS rank FROM (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
    SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= {k} UNION ALL SELECT query_id, chunk_id, rank FROM dense WHERE rank <= {k})
  GROUP BY ALL))"""


# ---- the ranked runs used by many queries -----------------------------------

RUN_K = 10
_COLUMNS = ["query_id", "chunk_id", "score", "rank"]


def _run(name, ranked):
    """A ranked run, written so that one query computes it once."""
    return stored(ranked.select(*_COLUMNS), f"run-{name}")


def bm25_run(spark, d):
    return _run("bm25", R.bm25_topk(chunks(spark, d), queries(spark, d), RUN_K))


def tfidf_run(spark, d):
    return _run("tfidf", R.tfidf_topk(chunks(spark, d), queries(spark, d), RUN_K))


def dense_run(spark, d):
    return _run("dense", R.dense_topk(chunk_vectors(spark, d), query_vectors(spark, d), RUN_K))


def fused_run(keyword, dense):
    return _run("rrf", R.rrf_merge([keyword, dense]))


def rrf_run(spark, d):
    return fused_run(bm25_run(spark, d), dense_run(spark, d))


BM25_RUN = f"{BM25},\nrun AS (SELECT * FROM bm25 WHERE rank <= {RUN_K})"
RRF_RUN = f"{BM25},\n{DENSE},\n{sql_rrf(RUN_K, 'run')}"
