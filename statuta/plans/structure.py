"""Queries over hierarchy parsing and chunking."""
from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.operators import chunking as K
from statuta.operators import cleaning as C
from statuta.operators import structure as S
from statuta.plans import inputs as I
from statuta.plans.cleaning import PAGES, pages_of
from statuta.plans.inputs import lit, sql_list, sql_strip
from statuta.plans.registry import query
from statuta.sources.tables import table
from statuta.unfold import unfold

# ---- inputs: every document's own lines, set as a legal text of known structure ----


def plain_lines(docs):
    """(doc_id, ls): lines without closing brackets, spaces collapsed, none empty."""
    lines = F.split(F.replace("text", F.lit(")"), F.lit(" ")), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))
    return docs.select("doc_id", F.filter(clean, lambda x: x != "").alias("ls"))


LS = """ls AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ')', ' '), chr(10)),
  lambda x: trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
li AS (SELECT doc_id, i - 1 AS i, (i - 1) // 10 AS b, (i - 1) % 10 AS r, ls[i] AS l, ls[i + 1] AS l2, len(ls) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM ls))"""


def structured(docs):
    """Roles by line number modulo ten: chapter, article, clause, points, text, references, pages."""
    doc = F.col("doc_id")
    header = F.when(doc % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("NGHỊ ĐỊNH"), F.concat(F.lit("Về việc "), doc.cast("string")), F.lit("Số: 5/NĐ"), F.lit("Căn cứ Luật"))
    )
    footer = F.when(
        doc % 3 == 0,
        F.array(*map(F.lit, ["Nơi nhận: x", "lost line", "Phụ lục I", "text of one", "Điều 9. in one", "Phụ lục II kèm theo", "Phụ lục III", "7", "text of three"])),
    ).otherwise(F.array().cast("array<string>"))
    s = lambda c: c.cast("string")

    def role(x, i):
        b, r = F.floor(i / 10), i % 10
        cat = lambda *parts: F.array(F.concat(*parts))
        return (
            F.when(r == 0, F.array(F.concat(F.lit("Chương "), s(b + 1)), F.concat(F.lit("TÊN CHƯƠNG "), s(b + 1)), F.concat(F.lit("+ "), x)))
            .when(r == 1, cat(F.lit("Điều "), s(2 * b + 1), F.lit(". "), x))
            .when(r == 2, cat(F.lit("1. "), x))
            .when(r == 3, cat(F.lit("a) "), x))
            .when(r == 5, cat(F.lit("b) "), x))
            .when(r == 6, cat(F.lit("2. "), x))
            .when(r == 7, cat(F.lit("Chương "), s(b + 1), F.lit(" của "), x))
            .when(r == 8, cat(F.lit("Điều "), s(2 * b + 2), F.lit(". "), x))
            .when(r == 9, F.array(F.concat(F.lit("[PAGE_"), s(b + 2), F.lit("]")), F.concat(F.lit("a) "), x)))
            .otherwise(cat(F.lit("+ "), x))
        )

    body = F.flatten(F.transform("ls", role))
    return plain_lines(docs).select("doc_id", F.array_join(F.concat(header, body, footer), "\n").alias("text"))


def structured_lines(spark, d):
    return S.lines_of(structured(I.documents(spark, d)))


_KINDS = ["page", "number", "footer", "appendix", "chapter", "chapter_reference", "section", "article", "clause", "point", "header_stop", "doc_type", "text"]
_HEADER_LINES = "['NGHỊ ĐỊNH|doc_type', 'Về việc|text', 'Số|text', 'Căn cứ|header_stop']"


@query("line_classify", f"""WITH {LS}, k AS (
  SELECT doc_id, unnest(CASE r WHEN 0 THEN ['chapter', 'text', 'text'] WHEN 1 THEN ['article'] WHEN 2 THEN ['clause'] WHEN 3 THEN ['point'] WHEN 5 THEN ['point']
    WHEN 6 THEN ['clause'] WHEN 7 THEN ['chapter_reference'] WHEN 8 THEN ['article'] WHEN 9 THEN ['page', 'point'] ELSE ['text'] END) AS kind FROM li
  UNION ALL SELECT doc_id, unnest(['doc_type', 'text', 'text', 'header_stop']) FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, unnest(['footer', 'text', 'appendix', 'text', 'article', 'text', 'appendix', 'number', 'text']) FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def line_classify(spark, d):
    return S.classify(structured_lines(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_NODES = """nodes AS (
  SELECT doc_id, b, r, CASE WHEN r IN (1, 8) THEN 'article' WHEN r IN (2, 6) THEN 'clause' ELSE 'point' END AS level, b + 1 AS chuong, CASE WHEN r = 8 THEN 2 * b + 2 ELSE 2 * b + 1 END AS dieu,
    CASE WHEN r IN (2, 3, 5) THEN '1' WHEN r = 6 THEN '2' END AS khoan, CASE r WHEN 3 THEN 'a' WHEN 5 THEN 'b' END AS diem,
    l || CASE WHEN l2 IS NULL THEN '' WHEN r = 3 THEN ' + ' || l2 WHEN r = 6 THEN ' Chương ' || (b + 1) || ' của ' || l2 ELSE '' END AS noi_dung
  FROM li WHERE r IN (1, 2, 3, 5, 6, 8))"""


@query("hierarchy_parse", f"""WITH {LS}, {_NODES}
SELECT doc_id, level, CAST(chuong AS VARCHAR) AS chuong, 'TÊN CHƯƠNG ' || chuong AS chuong_ten, CAST(dieu AS VARCHAR) AS dieu, khoan, diem, CAST(b + 1 AS INTEGER) AS page_number, noi_dung,
  CASE WHEN doc_id % 4 = 0 THEN 'Không xác định' ELSE 'NGHỊ ĐỊNH Về việc ' || doc_id END AS ten_van_ban FROM nodes""")
def hierarchy_parse(spark, d):
    lines = structured_lines(spark, d)
    return S.parse(lines, titled=True).drop("node_id")


@query("appendix_collect", """WITH x AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, 1::BIGINT AS number, 'Phụ lục I' AS tieu_de, 'text of one|Điều 9. in one|Phụ lục II kèm theo' AS noi_dung FROM x
UNION ALL SELECT doc_id, 2, 'Phụ lục III', 'text of three' FROM x""")
def appendix_collect(spark, d):
    out = S.appendices(structured_lines(spark, d))
    return out.withColumn("noi_dung", F.array_join("noi_dung", "|"))


@query("inline_point_split", """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, lower(l_returnflag) AS f, l_orderkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE k WHEN 0 THEN 'lead text ' || l_partkey || ': ' WHEN 1 THEN 'x ' || l_linenumber || ' ' || f || ') rest. ' WHEN 2 THEN 'one; ' END AS prefix,
  CASE WHEN k = 1 THEN 'c' WHEN k < 3 THEN f END AS letter, CASE k WHEN 0 THEN 'rest b) more' WHEN 1 THEN 'y' WHEN 2 THEN 'tail' END AS rest FROM x""")
def inline_point_split(spark, d):
    f, s = F.lower("l_returnflag"), lambda c: F.col(c).cast("string")
    kind = F.col("l_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("lead text "), s("l_partkey"), F.lit(": "), f, F.lit(") rest b) more")))
        .when(kind == 1, F.concat(F.lit("x "), s("l_linenumber"), F.lit(" "), f, F.lit(") rest. c) y")))
        .when(kind == 2, F.concat(F.lit("one; "), f, F.lit(") tail")))
        .otherwise(F.concat(F.lit("a longer text without marks before "), f, F.lit(") tail")))
    )
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return table(spark, d, "lineitem").select(*keys, S.inline_point(text).alias("i")).select(*keys, "i.*")


def flat_text(docs):
    """Roles modulo ten for the flat parser; text after an article waits for the next clause's end."""
    s = lambda c: c.cast("string")

    def role(x, i):
        b, r = F.floor(i / 10), i % 10
        return (
            F.when(r == 1, F.concat(F.lit("Điều "), s(b + 1), F.lit(": "), x))
            .when(r == 3, F.concat(F.lit("1. "), x))
            .when(r == 5, F.concat(F.lit("a) "), x))
            .when(r == 7, F.concat(F.lit("đ) "), x))
            .when(r == 8, F.concat(F.lit("2. "), x))
            .otherwise(F.concat(F.lit("+ "), x))
        )

    return plain_lines(docs).select("doc_id", F.array_join(F.transform("ls", role), "\n").alias("text"))


@query("hierarchy_parse_flat", f"""WITH {LS},
e AS (SELECT doc_id, i, b, r, n, l, CASE r WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 3 WHEN 8 THEN 2 END AS lev FROM li),
nodes AS (SELECT *, lead(lev) OVER w AS nxt, row_number() OVER w AS k FROM e WHERE lev IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
tk AS (SELECT *, nxt IS NULL OR nxt = 1 OR (nxt = 2 AND lev >= 2) OR (nxt = 3 AND lev = 3) AS takes FROM nodes),
al AS (SELECT e.doc_id, e.i, e.l, e.lev, sum(CASE WHEN e.lev IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS k0,
  min(CASE WHEN tk.takes THEN tk.k END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM e LEFT JOIN tk USING (doc_id, i)),
asg AS (SELECT al.doc_id, al.i, '+ ' || al.l AS t, CASE WHEN tk.takes THEN tk.k ELSE al.ahead END AS k FROM al LEFT JOIN tk ON tk.doc_id = al.doc_id AND tk.k = al.k0 WHERE al.lev IS NULL),
w AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY i) AS w FROM asg WHERE k IS NOT NULL GROUP BY ALL)
SELECT doc_id, CASE lev WHEN 1 THEN 'article' WHEN 2 THEN 'clause' ELSE 'point' END AS level, CAST(b + 1 AS VARCHAR) AS dieu,
  CASE WHEN r IN (3, 5, 7) THEN '1' WHEN r = 8 THEN '2' END AS khoan, CASE r WHEN 5 THEN 'a' WHEN 7 THEN 'đ' END AS diem, CASE WHEN lev = 1 THEN l END AS tieu_de,
  CASE WHEN w IS NULL THEN CASE WHEN lev = 1 THEN '' ELSE l END WHEN nxt IS NULL THEN CASE WHEN lev = 1 THEN '' ELSE l END || ' ' || w ELSE w END AS noi_dung
FROM tk LEFT JOIN w USING (doc_id, k)""")
def hierarchy_parse_flat(spark, d):
    return S.parse_flat(S.lines_of(flat_text(I.documents(spark, d)))).drop("node_id")


def text_v2(docs):
    """Roles modulo ten for the second parser: bases, long names and titles, references, misread letters."""
    s = lambda c: c.cast("string")
    doc = F.col("doc_id")
    header = F.array(F.concat(F.lit("Căn cứ Luật "), s(doc)), F.lit("và luật khác;"), F.lit("Căn cứ B;"), F.lit("Căn cứ C"), F.lit("hết;"), F.lit("preface"))

    def role(x, i):
        b, r = F.floor(i / 10), i % 10
        return (
            F.when(r == 0, F.concat(F.lit("Chương "), s(b + 1), F.lit(". Tên\n+ "), x))
            .when(r == 1, F.concat(F.lit("Điều "), s(b + 1), F.lit(". "), x))
            .when(r == 3, F.concat(F.lit("1. "), x))
            .when(r == 4, F.concat(F.lit("Điều 7. Luật "), x))
            .when(r == 5, F.concat(F.lit("a) "), x))
            .when(r == 6, F.concat(F.lit("1) "), x))
            .when((r == 8) & (doc % 2 == 0), F.concat(F.lit("2. "), x))
            .when((r == 9) & (doc % 2 == 0), F.concat(F.lit("1) "), x))
            .when((r == 8) & (doc % 2 == 1), F.concat(F.lit("b) "), x))
            .otherwise(F.concat(F.lit("+ "), x))
        )

    return plain_lines(docs).select("doc_id", F.array_join(F.concat(header, F.transform("ls", role)), "\n").alias("text"))


@query("hierarchy_parse_v2", f"""WITH {LS}, y AS (SELECT *, n - 10 * b AS m, n > 10 * (b + 1) AS more, doc_id % 2 = 0 AS even,
  ls[10*b+1] AS l0, ls[10*b+3] AS t2, ls[10*b+5] AS t4, ls[10*b+8] AS t7, ls[10*b+10] AS t9 FROM li JOIN ls USING (doc_id))
SELECT doc_id, level, chuong, dieu, khoan, diem, noi_dung FROM (
  SELECT doc_id, 'chapter' AS level, CAST(b + 1 AS VARCHAR) AS chuong, NULL AS dieu, NULL AS khoan, NULL AS diem, CASE WHEN m > 1 THEN 'Tên + ' || l ELSE '' END AS noi_dung FROM y WHERE r = 0
  UNION ALL SELECT doc_id, 'article', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), NULL, NULL, l || CASE WHEN m > 2 THEN ' + ' || t2 ELSE '' END FROM y WHERE r = 1
  UNION ALL SELECT doc_id, 'clause', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), '1', NULL, l || CASE WHEN m > 4 AND (even OR b = 0) THEN ' Điều 7. Luật ' || t4 ELSE '' END FROM y WHERE r = 3
  UNION ALL SELECT doc_id, 'point', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), '1', 'a', l FROM y WHERE r = 5
  UNION ALL SELECT doc_id, 'point', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), '1', 'l', l || CASE WHEN m > 7 THEN ' + ' || t7 ELSE '' END FROM y WHERE r = 6
  UNION ALL SELECT doc_id, 'clause', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), '2', NULL, l || CASE WHEN m > 9 AND NOT more THEN ' 1) ' || t9 ELSE '' END FROM y WHERE r = 8 AND even
  UNION ALL SELECT doc_id, 'point', CAST(b + 1 AS VARCHAR), CAST(b + 1 AS VARCHAR), '1', 'b', l || CASE WHEN m > 9 AND NOT more THEN ' + ' || t9 ELSE '' END FROM y WHERE r = 8 AND NOT even
  UNION ALL SELECT doc_id, 'basis', NULL, NULL, NULL, NULL, unnest(['Căn cứ Luật ' || doc_id || ' và luật khác;', 'Căn cứ B; Căn cứ C hết;']) FROM documents)""")
def hierarchy_parse_v2(spark, d):
    lines = S.lines_of(text_v2(I.documents(spark, d)))
    null = F.lit(None).cast("string")
    basis = S.basis_blocks(lines).select(
        "doc_id", F.lit("basis").alias("level"), null.alias("chuong"), null.alias("dieu"), null.alias("khoan"), null.alias("diem"), F.col("text").alias("noi_dung")
    )
    return S.parse_v2(lines).drop("node_id").unionByName(basis)


@query("parse_quality", f"""WITH {LS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Không xác định' ELSE 'NGHỊ ĐỊNH Về việc ' || doc_id END AS ten_van_ban,
  CASE WHEN doc_id % 4 = 0 THEN 'low' ELSE 'high' END AS quality, CAST(CASE WHEN len(ls) > 1 THEN (len(ls) - 2) // 10 + 1 ELSE 0 END AS BIGINT) AS n_chapters,
  CASE WHEN len(ls) > 1 THEN '' ELSE 'no chapters' END AS warning FROM ls""")
def parse_quality(spark, d):
    docs = structured(I.documents(spark, d))
    return S.parse_quality(docs, S.lines_of(docs))


# ---- nested documents ----


def nested(docs):
    """Documents as chapters of five lines: an article alone, and one with a clause and a clause of two points."""
    at = lambda b, k: F.coalesce(F.try_element_at("ls", (b * 5 + k).cast("int")), F.lit(""))
    page = lambda b: (b + 1).cast("int").alias("page_number")

    def chapter(b):
        points = F.array(
            F.struct(F.lit("a").alias("diem_ky_hieu"), at(b, 4).alias("noi_dung"), page(b)),
            F.struct(F.lit("b").alias("diem_ky_hieu"), at(b, 5).alias("noi_dung"), page(b)),
        )
        clauses = F.array(
            F.struct(F.lit("1").alias("khoan_so"), at(b, 3).alias("noi_dung"), page(b), F.array().cast(f"array<{K.POINT}>").alias("diem")),
            F.struct(F.lit("2").alias("khoan_so"), F.when(b % 2 == 0, at(b, 3)).otherwise("").alias("noi_dung"), page(b), points.alias("diem")),
        )
        articles = F.array(
            F.struct((2 * b + 1).cast("string").alias("dieu_so"), at(b, 1).alias("noi_dung"), page(b), F.array().cast(f"array<{K.CLAUSE}>").alias("khoan")),
            F.struct((2 * b + 2).cast("string").alias("dieu_so"), at(b, 2).alias("noi_dung"), page(b), clauses.alias("khoan")),
        )
        return F.struct(
            F.when(b % 3 == 2, F.lit("")).otherwise((b + 1).cast("string")).alias("chuong_so"), F.lit("TÊN").alias("chuong_ten"), page(b), articles.alias("dieu")
        )

    doc = F.col("doc_id")
    meta = F.struct(
        F.lit("LUẬT").alias("loai_van_ban"), doc.cast("string").alias("so_hieu"), F.lit("BỘ").alias("co_quan_ban_hanh"), F.lit("1/2/2025").alias("ngay_ban_hanh")
    )
    blocks = F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 5).cast("int"))
    return plain_lines(docs).filter(F.size("ls") > 0).select(
        "doc_id", F.when(doc % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Luật "), doc.cast("string"))).alias("ten_van_ban"), meta.alias("metadata"),
        F.array(F.concat(F.lit("Hiến pháp "), doc.cast("string")), F.lit("Luật X")).alias("can_cu_phap_ly"),
        F.transform(blocks, chapter).alias("chuong"), F.concat(F.lit("f"), doc.cast("string"), F.lit(".json")).alias("source_file"),
    )


_BLOCKS = LS + """, bl AS (SELECT doc_id, b, coalesce(ls[5*b+1], '') AS l1, coalesce(ls[5*b+2], '') AS l2, coalesce(ls[5*b+3], '') AS l3, coalesce(ls[5*b+4], '') AS l4, coalesce(ls[5*b+5], '') AS l5,
  CASE WHEN b % 3 = 2 THEN '' ELSE CAST(b + 1 AS VARCHAR) END AS c, CAST(b + 1 AS INTEGER) AS page, CAST(2*b+1 AS VARCHAR) AS d1, CAST(2*b+2 AS VARCHAR) AS d2
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 5 + 1)) AS b FROM ls WHERE len(ls) > 0))"""

_LEAF = _BLOCKS + """, t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Luật ' || doc_id END AS vb, CASE WHEN b % 2 = 0 AND l3 <> '' THEN ' (' || l3 || ')' ELSE '' END AS lead FROM bl),
leaf AS (SELECT doc_id, 'Theo Điều ' || d1 || ' ' || vb || ' ' || l1 AS text, vb AS van_ban, c AS chuong, d1 AS dieu, NULL AS khoan, NULL AS diem, page FROM t
  UNION ALL SELECT doc_id, 'Khoản 1 Điều ' || d2 || ' ' || vb || ' ' || l3, vb, c, d2, '1', NULL, page FROM t
  UNION ALL SELECT doc_id, 'Tại điểm a Khoản 2 Điều ' || d2 || ' ' || vb || lead || ' ' || l4, vb, c, d2, '2', 'a', page FROM t
  UNION ALL SELECT doc_id, 'Tại điểm b Khoản 2 Điều ' || d2 || ' ' || vb || lead || ' ' || l5, vb, c, d2, '2', 'b', page FROM t)"""


@query("chunk_leaf", f"""WITH {_LEAF} SELECT doc_id, text, van_ban, chuong, dieu, khoan, diem, 'f' || doc_id || '.json' AS source_file, page AS page_number FROM leaf""")
def chunk_leaf(spark, d):
    return K.chunk_leaf(nested(I.documents(spark, d))).drop("at")


@query("nested_doc_scan", f"""WITH {_BLOCKS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Luật ' || doc_id END AS ten_van_ban, count(*) AS n_chapters, 2 * count(*) AS n_articles,
  CAST(sum(len(l1) + len(l2)) AS BIGINT) AS article_chars, true AS has_path FROM bl GROUP BY ALL""")
def nested_doc_scan(spark, d):
    from statuta.session import shared_folder
    from statuta.sources.documents import nested_documents
    import uuid

    path = f"{shared_folder(spark)}/nested-{uuid.uuid4().hex}"
    nested(I.documents(spark, d)).write.json(path)
    docs = nested_documents(spark, path, multi_line=False)
    articles = F.flatten(F.transform("chuong", lambda c: c["dieu"]))
    return docs.select(
        "doc_id", "ten_van_ban", F.size("chuong").cast("long").alias("n_chapters"), F.size(articles).cast("long").alias("n_articles"),
        F.aggregate(articles, F.lit(0).cast("long"), lambda a, x: a + F.length(x["noi_dung"])).alias("article_chars"),
        F.contains("path", F.lit("nested-")).alias("has_path"),
    )


@query("chunk_typed", f"""WITH {_BLOCKS}, t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'LUẬT ' ELSE 'Luật ' END || doc_id AS vb, CASE WHEN c = '' THEN '' ELSE 'Chương ' || c END AS cp FROM bl),
x AS (SELECT doc_id, 0 AS part, 0 AS b, 0 AS o, 'metadata' AS type, vb || chr(10) || 'Cơ quan ban hành: BỘ' || chr(10) || 'Ngày ban hành: 1/2/2025' AS text, vb, NULL AS c, NULL AS dieu, NULL AS khoan, NULL AS diem, NULL AS page FROM t WHERE b = 0
  UNION ALL SELECT doc_id, 1, 0, i, 'can_cu', 'Căn cứ ' || i || ' của ' || vb || ': ' || CASE i WHEN 1 THEN 'Hiến pháp ' || doc_id ELSE 'Luật X' END, vb, NULL, NULL, NULL, NULL, NULL FROM t, (VALUES (1), (2)) v(i) WHERE b = 0
  UNION ALL SELECT doc_id, 2, b, 1, 'dieu', CASE WHEN c = '' THEN '' ELSE cp || ' (TÊN). ' END || 'Theo Điều ' || d1 || ' của ' || vb || ': ' || l1, vb, c, d1, NULL, NULL, page FROM t
  UNION ALL SELECT doc_id, 2, b, 2, 'khoan', CASE WHEN c = '' THEN '' ELSE cp || '. ' END || 'Khoản 1, Điều ' || d2 || ' của ' || vb || ': ' || l3, vb, c, d2, '1', NULL, page FROM t
  UNION ALL SELECT doc_id, 2, b, 3, 'diem', CASE WHEN c = '' THEN '' ELSE cp || '. ' END || 'Tại điểm a, Khoản 2, Điều ' || d2 || ' của ' || vb || ': ' || l4, vb, c, d2, '2', 'a', page FROM t
  UNION ALL SELECT doc_id, 2, b, 4, 'diem', CASE WHEN c = '' THEN '' ELSE cp || '. ' END || 'Tại điểm b, Khoản 2, Điều ' || d2 || ' của ' || vb || ': ' || l5, vb, c, d2, '2', 'b', page FROM t)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, b, o) AS chunk_no, type, {sql_strip('text')} AS text, vb AS van_ban, c AS chuong, dieu, khoan, diem, page AS page_number FROM x""")
def chunk_typed(spark, d):
    out = K.chunk_typed(nested(I.documents(spark, d)))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("chunk_enrich_dedup", f"""WITH s AS (SELECT doc_id, sha256(text) AS sha, lang, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, sha, lang, source, i - 1 AS idx, {sql_strip('ls[i]')} AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) AS n FROM l WHERE text <> '')
SELECT doc_id, CAST(idx AS BIGINT) AS chunk_index, text, len(text) < 10 AS short, 'doc_' || substr(sha, 1, 16) AS doc_key, sha AS file_sha256, source || '.pdf' AS file_name, lang AS loai_van_ban FROM r WHERE n = 1""")
def chunk_enrich_dedup(spark, d):
    docs = I.documents(spark, d)
    chunks = unfold(docs, ["doc_id"], F.split("text", "\n"), "text", "idx")
    sha = F.sha2("text", 256)
    fields = docs.select(
        "doc_id", F.concat(F.lit("doc_"), F.substring(sha, 1, 16)).alias("doc_key"), sha.alias("file_sha256"),
        F.concat("source", F.lit(".pdf")).alias("file_name"), F.col("lang").alias("loai_van_ban"),
    )
    return K.chunk_enrich(chunks, fields).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("token_windows", f"""WITH t AS (SELECT doc_id, {I.sql_words('text')} AS t FROM documents),
w AS (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 254 THEN [0::BIGINT] ELSE range(0, len(t), 222) END) AS s FROM t)
SELECT doc_id, doc_id || '_' || (s // 222) AS window_id, s AS start, least(s + 254, len(t)) - 1 AS stop, array_to_string(t[s + 1 : s + 254], ' ') AS text FROM w""")
def token_windows(spark, d):
    return K.token_windows(I.documents(spark, d))


@query("text_vs_scan", f"""WITH {PAGES},
a AS (SELECT doc_id, CAST(sum(len({sql_strip('text')})) AS BIGINT) AS chars, coalesce(max(CASE WHEN p = 1 THEN len({sql_strip('text')}) END), 0) AS first FROM pages_of GROUP BY doc_id)
SELECT doc_id, chars, CASE WHEN chars < 100 THEN 'scan' ELSE 'text' END AS route, CASE WHEN first > 50 THEN 'text' ELSE 'scan' END AS route_first FROM a""")
def text_vs_scan(spark, d):
    pages = pages_of(I.documents(spark, d)).withColumn("page_no", F.regexp_extract("page_key", "[0-9]+", 0).cast("int"))
    return K.text_or_scan(pages.select("doc_id", "page_no", "text"))


_TERMS = ["the on", "in the", "that", "under", "und die", "la que", "nicht"]


@query("ingest_report", f"""WITH g AS (SELECT doc_id, text, source, CASE WHEN len(text) < 500 THEN 'too_short' WHEN len(list_filter({sql_list(_TERMS)}, lambda t: contains(lower(text), t))) < 2 THEN 'too_few_terms' ELSE 'accepted' END AS gate FROM documents),
c AS (SELECT doc_id, count(*) AS num_chunks, count(*) FILTER (len({sql_strip('t')}) < 10) AS num_short FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE doc_id % 9 > 0) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(text) AS BIGINT) AS text_length, coalesce(num_chunks, 0) AS num_chunks, coalesce(num_short, 0) AS num_short, CASE WHEN doc_id < (SELECT count(*) FROM embeddings) THEN 64::BIGINT ELSE 0 END AS embedding_dim,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1::BIGINT ELSE 0 END AS stored_chunks, gate, CASE WHEN source = 'src1' THEN 'low' ELSE 'high' END AS q FROM g LEFT JOIN c USING (doc_id)),
y AS (SELECT *, concat_ws(';', CASE WHEN gate <> 'accepted' THEN 'text: ' || gate END, CASE WHEN num_chunks = 0 THEN 'no chunks' END, CASE WHEN stored_chunks > 0 THEN 'duplicate document' END) AS errors,
  concat_ws(';', CASE WHEN q = 'low' THEN 'no title' END, CASE WHEN num_short > 0 THEN 'short chunks: ' || num_short END) AS warnings FROM x)
SELECT doc_id, CASE WHEN errors <> '' THEN 'failed' ELSE 'success' END AS status, text_length, num_chunks, embedding_dim, stored_chunks, warnings, errors FROM y""")
def ingest_report(spark, d):
    docs = C.text_gate(I.documents(spark, d), _TERMS).select(
        "doc_id", "text", F.col("status").alias("gate"), F.when(F.col("source") == "src1", F.lit("low")).otherwise(F.lit("high")).alias("quality")
    )
    chunks = I.documents(spark, d).filter("doc_id % 9 > 0").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = K.ingest_report(docs, chunks, vectors, table(spark, d, "labels").select("doc_id"))
    return out.withColumns({c: F.array_join(c, ";") for c in ("warnings", "errors")})
