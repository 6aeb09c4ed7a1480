"""Queries over joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.operators import boosts as B
from statuta.operators import matching as M
from statuta.operators import retrieval as R
from statuta.plans import inputs as I
from statuta.plans.inputs import lit, sql_words
from statuta.plans.registry import query
from statuta.sources.tables import table

BARE = "lower(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query("cascade_enrich", f"""WITH c AS (SELECT doc_id, text, source AS van_ban, lang AS dieu, CAST(doc_id % 7 AS VARCHAR) AS khoan, doc_id AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'own.pdf' END AS source_file FROM documents),
k AS (SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN text || ' extra' ELSE '(' || text || ') !' END AS text, source AS van_ban, lang AS dieu, CAST(doc_id % 7 AS VARCHAR) AS khoan, doc_id AS chunk_index, 's' || doc_id || '.pdf' AS sf, doc_id % 40 AS page FROM documents WHERE doc_id % 3 = 0),
kt AS (SELECT {BARE.format('text')} AS key, arg_max(sf, pos) AS sf, arg_max(page, pos) AS page FROM k GROUP BY 1),
kp AS (SELECT concat_ws('|', {BARE.format('van_ban')}, {BARE.format('dieu')}, khoan, chunk_index) AS key, arg_max(sf, pos) AS sf, arg_max(page, pos) AS page FROM k GROUP BY 1),
x AS (SELECT c.*, coalesce(kt.sf, kp.sf) AS f, CASE WHEN kt.sf IS NOT NULL THEN kt.page ELSE kp.page END AS page FROM c LEFT JOIN kt ON kt.key = {BARE.format('text')} LEFT JOIN kp ON kp.key = concat_ws('|', {BARE.format('van_ban')}, {BARE.format('dieu')}, khoan, chunk_index))
SELECT doc_id, CASE WHEN source_file <> '' THEN source_file WHEN f IS NOT NULL THEN f WHEN contains(van_ban, 'src1') THEN 'one.pdf' WHEN contains(van_ban, 'src2') THEN 'two.pdf' ELSE '' END AS source_file,
  source_file = '' AND f IS NOT NULL AS enriched, CASE WHEN source_file = '' AND f IS NOT NULL THEN page END AS page_number, count(*) FILTER (source_file = '' AND f IS NOT NULL) OVER () AS n_enriched FROM x""")
def cascade_enrich(spark, d):
    key = F.col("doc_id")
    base = I.documents(spark, d).select(
        "doc_id", "text", F.col("source").alias("van_ban"), F.col("lang").alias("dieu"), (key % 7).cast("string").alias("khoan"), key.alias("chunk_index")
    )
    corpus = base.withColumn("source_file", F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("own.pdf"))).withColumn("page_number", F.lit(None).cast("long"))
    text = F.when(key % 5 == 0, F.concat("text", F.lit(" extra"))).otherwise(F.concat(F.lit("("), "text", F.lit(") !")))
    known = base.filter("doc_id % 3 = 0").withColumn("text", text).withColumn("pos", key).withColumn(
        "source_file", F.concat(F.lit("s"), key.cast("string"), F.lit(".pdf"))
    ).withColumn("page_number", key % 40)
    out = M.cascade_enrich(corpus, known, [(F.contains("van_ban", F.lit("src1")), "one.pdf"), (F.contains("van_ban", F.lit("src2")), "two.pdf")])
    n = out.agg(F.count_if("enriched")).scalar()
    return out.select("doc_id", "source_file", "enriched", "page_number").withColumn("n_enriched", n)


# ---- expectations: for each item the best and third keyword chunk, as number, as place, as article ----


def gold(spark, d):
    """(query_id, expected_citations) made from documents chosen by item number."""
    n = table(spark, d, "documents").agg(F.count("*")).scalar()
    picks = I.queries(spark, d).withColumn("n", n).select(
        "query_id", F.explode(F.array(*[(F.col("query_id") * m + a) % F.col("n") for m, a in ((1, 0), (7, 3), (13, 5))])).alias("chunk_id")
    ).distinct()
    c = I.chunks(spark, d).select("chunk_id", "van_ban", "chuong", "dieu", "khoan", "diem")
    kind = F.col("chunk_id") % 3
    cite = F.struct(
        F.when(kind == 0, F.lit("none")).otherwise(F.col("van_ban")).alias("van_ban"), "chuong", "dieu",
        F.when(kind == 2, F.lit("")).otherwise(F.col("khoan")).alias("khoan"), "diem",
        F.when(kind == 1, F.lit(-1)).otherwise(F.col("chunk_id")).cast("long").alias("chunk_index"),
    )
    return picks.join(c, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(cite)).alias("expected_citations"))


GOLD = f"""{I.CHUNKS}, gold AS (SELECT DISTINCT query_id, CASE WHEN chunk_id % 3 = 0 THEN 'none' ELSE van_ban END AS van_ban, dieu, CASE WHEN chunk_id % 3 = 2 THEN '' ELSE khoan END AS khoan,
  CASE WHEN chunk_id % 3 = 1 THEN -1 ELSE chunk_id END AS chunk_index FROM (SELECT item_id AS query_id, unnest([item_id % n, (item_id * 7 + 3) % n, (item_id * 13 + 5) % n]) AS chunk_id FROM benchmark, (SELECT count(*) AS n FROM documents)) JOIN chunks USING (chunk_id))"""


def run_rows(spark, d, run, columns=("van_ban", "chuong", "dieu", "khoan", "diem")):
    out = B.with_text(run, I.chunks(spark, d), run.count(), columns)
    return out.withColumn("chunk_index", F.col("chunk_id"))


HIT = "EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND ((g.chunk_index <> -1 AND g.chunk_index = r.chunk_id) OR (g.van_ban = c.van_ban AND g.dieu = c.dieu AND g.khoan = c.khoan)))"
MATCHED = "EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND (g.chunk_index = r.chunk_id OR (g.dieu = c.dieu AND (g.khoan = '' OR g.khoan = c.khoan))))"


@query("hit_join", f"WITH {I.RRF_RUN}, {GOLD} SELECT r.query_id, r.chunk_id, r.rank, {HIT} AS hit FROM run r JOIN chunks c USING (chunk_id)")
def hit_join(spark, d):
    out = M.hit_join(run_rows(spark, d, I.rrf_run(spark, d)), gold(spark, d))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "hit")


@query("chunk_citation_match", f"WITH {I.RRF_RUN}, {GOLD} SELECT r.query_id, r.chunk_id, r.rank, {MATCHED} AS matched FROM run r JOIN chunks c USING (chunk_id)")
def chunk_citation_match(spark, d):
    out = M.chunk_citation_match(run_rows(spark, d, I.rrf_run(spark, d)), gold(spark, d))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "matched")


def cited_lines(spark, d):
    """Order lines as an answer's citations, with empty parts here and there."""
    s = lambda c: F.col(c).cast("string")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("out_no"),
        F.when(F.col("l_partkey") % 5 > 0, (F.col("l_orderkey") % 9).cast("string")).alias("dieu"),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit(" "), s("l_linenumber"))).alias("khoan"),
        F.when(F.col("l_partkey") % 2 > 0, F.lower("l_returnflag")).otherwise("").alias("diem"),
    )


def expected_orders(spark, d):
    """Two expected citations per order."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    one = F.struct(F.lit(1).alias("exp_no"), F.when(key % 4 > 0, (key % 9).cast("string")).alias("dieu"), F.when(key % 3 > 0, (key % 7 + 1).cast("string")).alias("khoan"), F.lit("").alias("diem"))
    two = F.struct(F.lit(2).alias("exp_no"), (key % 9).cast("string").alias("dieu"), F.lit(None).cast("string").alias("khoan"), F.when(key % 2 > 0, F.lit("n")).alias("diem"))
    return o.select(key.alias("query_id"), F.explode(F.array(one, two)).alias("e")).select("query_id", "e.*")


CITED_PAIRS = """o AS (SELECT l_orderkey AS query_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS out_no, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_orderkey % 9 AS VARCHAR) ELSE '' END AS dieu,
  CASE WHEN l_partkey % 3 > 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS khoan, CASE WHEN l_partkey % 2 > 0 THEN lower(l_returnflag) ELSE '' END AS diem FROM lineitem),
e AS (SELECT o_orderkey AS query_id, 1 AS exp_no, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE '' END AS dieu, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 7 + 1 AS VARCHAR) ELSE '' END AS khoan, '' AS diem FROM orders
  UNION ALL SELECT o_orderkey, 2, CAST(o_orderkey % 9 AS VARCHAR), '', CASE WHEN o_orderkey % 2 > 0 THEN 'n' ELSE '' END FROM orders),
mt AS (SELECT o.query_id, o.out_no, e.exp_no FROM o JOIN e USING (query_id) WHERE (o.dieu = '') = (e.dieu = '') AND o.dieu = e.dieu AND (o.khoan = '' OR e.khoan = '' OR o.khoan = e.khoan)
  AND (o.diem = '' OR e.diem = '' OR o.diem = e.diem) AND ((o.dieu <> '' AND e.dieu <> '') OR (o.khoan <> '' AND e.khoan <> '') OR (o.diem <> '' AND e.diem <> '')))"""


@query("citation_match", f"WITH {CITED_PAIRS} SELECT query_id, out_no, exp_no FROM mt")
def citation_match(spark, d):
    return M.citation_pairs(cited_lines(spark, d), expected_orders(spark, d))


@query("citation_backfill", f"""WITH {I.RRF_RUN}, {I.CHUNKS}, ci AS (SELECT item_id AS query_id, n AS cite_no, CASE WHEN n = 4 THEN 'Given' WHEN n = 3 THEN 'N/A' ELSE '' END AS van_ban,
  CASE WHEN n = 2 THEN NULL ELSE ['en', 'de', 'fr', 'xx', 'es'][1 + (item_id + n) % 5] END AS dieu, CASE WHEN n = 1 THEN NULL ELSE CAST((item_id + n) % 7 AS VARCHAR) END AS khoan FROM benchmark, (VALUES (1), (2), (3), (4), (5)) v(n)),
rk AS (SELECT r.query_id, r.rank, CASE WHEN chunk_id % 13 = 0 THEN '' ELSE van_ban END AS van_ban, dieu, khoan, page_number, source_file FROM run r JOIN chunks USING (chunk_id)),
j AS (SELECT ci.query_id, cite_no, rank, rk.van_ban, rk.page_number, rk.source_file, CASE WHEN rk.dieu = ci.dieu AND rk.khoan = ci.khoan THEN 1 WHEN rk.dieu = ci.dieu THEN 2 WHEN rank = 1 AND rk.van_ban <> '' THEN 3 END AS cl
  FROM ci JOIN rk USING (query_id) WHERE ci.van_ban IN ('', 'N/A')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cite_no ORDER BY cl, rank) AS n FROM j WHERE cl IS NOT NULL) WHERE n = 1 AND van_ban <> '')
SELECT ci.query_id, cite_no, coalesce(b.van_ban, ci.van_ban) AS van_ban, dieu, khoan, b.page_number, b.source_file FROM ci LEFT JOIN b USING (query_id, cite_no)""")
def citation_backfill(spark, d):
    q = I.queries(spark, d).select("query_id", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("cite_no"))
    n, k = F.col("cite_no"), F.col("query_id") + F.col("cite_no")
    langs = F.array(*map(F.lit, ("en", "de", "fr", "xx", "es")))
    cites = q.select(
        "query_id", "cite_no", F.when(n == 4, F.lit("Given")).when(n == 3, F.lit("N/A")).otherwise("").alias("van_ban"),
        F.when(n != 2, F.element_at(langs, (k % 5 + 1).cast("int"))).alias("dieu"), F.when(n != 1, (k % 7).cast("string")).alias("khoan"),
    )
    ranked = run_rows(spark, d, I.rrf_run(spark, d), ("van_ban", "dieu", "khoan", "page_number", "source_file"))
    ranked = ranked.withColumn("van_ban", F.when(F.col("chunk_id") % 13 == 0, F.lit("")).otherwise(F.col("van_ban")))
    return M.citation_backfill(cites, ranked)


@query("ingest_duplicate_check", """WITH s AS (SELECT 'doc_' || (doc_id % 400) AS doc_id, sha256(text) AS sha, unnest(range(0, 1 + doc_id % 3)) AS i FROM documents WHERE doc_id % 2 = 0),
f AS (SELECT doc_id AS file_id, 'doc_' || (doc_id % 900 + 100) AS doc_id, sha256(CASE WHEN doc_id % 4 = 1 THEN text || 'x' ELSE text END) AS sha FROM documents),
j AS (SELECT file_id, f.doc_id, f.sha, count(s.i) AS n FROM f LEFT JOIN s ON s.doc_id = f.doc_id OR s.sha = f.sha GROUP BY ALL)
SELECT file_id, doc_id, n AS stored_chunks, n > 0 AS already_exists FROM j""")
def ingest_duplicate_check(spark, d):
    docs = I.documents(spark, d)
    key = F.col("doc_id")
    name = lambda c: F.concat(F.lit("doc_"), c.cast("string")).alias("doc_id")
    store = docs.filter("doc_id % 2 = 0").select(
        name(key % 400), F.sha2("text", 256).alias("sha256"), F.explode(F.sequence(F.lit(0).cast("long"), key % 3)).alias("i")
    ).drop("i")
    content = F.when(key % 4 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    files = docs.select(key.alias("file_id"), name(key % 900 + 100), F.sha2(content, 256).alias("sha256"))
    return M.duplicate_check(files, store).drop("sha256")


@query("similar_to_positive", f"""WITH w AS (SELECT doc_id, list_distinct({sql_words('lower(text)')}) AS ws FROM documents)
SELECT a.doc_id, CASE WHEN len(a.ws) = 0 THEN false ELSE len(list_intersect(a.ws, b.ws)) / len(a.ws)::DOUBLE > 0.3 END AS similar FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def similar_to_positive(spark, d):
    a = I.documents(spark, d).select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", R.similar(F.col("other"), F.col("text"), 0.3).alias("similar"))


@query("phrase_scan_join", """SELECT item_id AS phrase_id, doc_id AS chunk_id FROM benchmark b JOIN documents t ON contains(lower(t.text), lower(b.text))
UNION ALL SELECT 1000000 + label, doc_id FROM (SELECT DISTINCT label FROM embeddings WHERE label < 3) JOIN documents ON contains(lower(text), 'que l' || substr('aeo', CAST(label + 1 AS BIGINT), 1))""")
def phrase_scan_join(spark, d):
    long = I.queries(spark, d).select(F.col("query_id").alias("phrase_id"), F.lower("query").alias("phrase"))
    short = table(spark, d, "embeddings").filter("label < 3").select("label").distinct().select(
        (F.col("label") + 1000000).cast("long").alias("phrase_id"), F.concat(F.lit("que l"), F.substring(F.lit("aeo"), F.col("label") + 1, F.lit(1))).alias("phrase")
    )
    return M.phrase_scan(I.chunks(spark, d), long.unionByName(short))


@query("conversation_join", """SELECT m.conv_id, turn, role, c_custkey AS user_id, c_name AS name FROM conversations m JOIN customer ON c_custkey = conv_id % 60 WHERE c_mktsegment = 'BUILDING'""")
def conversation_join(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_mktsegment")
    messages = table(spark, d, "conversations").select("conv_id", "turn", "role")
    convs = messages.select("conv_id").distinct().withColumn("user_id", F.col("conv_id") % 60)
    return M.conversation_join(users, convs, messages, F.col("c_mktsegment") == "BUILDING")


@query("report_chunk_lookup", f"""WITH {I.RRF_RUN}, {I.CHUNKS} SELECT query_id, chunk_id, rank, van_ban, dieu, khoan, van_ban = 'src7' AS is_target, bool_or(van_ban = 'src7') OVER (PARTITION BY query_id) AS found FROM run JOIN chunks USING (chunk_id)""")
def report_chunk_lookup(spark, d):
    run = I.rrf_run(spark, d)
    meta = I.chunks(spark, d).select("chunk_id", "van_ban", "dieu", "khoan")
    out = M.chunk_lookup(run, meta, run.count(), F.col("van_ban") == "src7")
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "van_ban", "dieu", "khoan", "is_target", "found")
