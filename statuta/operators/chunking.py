"""Chunks from nested documents, their enrichment, windows of tokens, ingest routing and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import strip, words
from statuta.unfold import unfold

POINT = "struct<diem_ky_hieu:string,noi_dung:string,page_number:int>"
CLAUSE = f"struct<khoan_so:string,noi_dung:string,page_number:int,diem:array<{POINT}>>"
ARTICLE = f"struct<dieu_so:string,noi_dung:string,page_number:int,khoan:array<{CLAUSE}>>"
CHAPTER = f"struct<chuong_so:string,chuong_ten:string,page_number:int,dieu:array<{ARTICLE}>>"
METADATA = "struct<loai_van_ban:string,so_hieu:string,co_quan_ban_hanh:string,ngay_ban_hanh:string>"
NESTED = (
    f"doc_id bigint, ten_van_ban string, metadata {METADATA}, can_cu_phap_ly array<string>, "
    f"chuong array<{CHAPTER}>, source_file string"
)


def _leaves(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per article without clauses, clause without points, or point; ``at`` orders them.

    Each level hands down its own fields and the level below, never what is already unfolded.
    """
    c, a, k = F.col("_c"), F.col("_a"), F.col("_k")
    chapter = [c["chuong_so"].alias("c_so"), c["chuong_ten"].alias("c_ten")]
    out = unfold(docs, keep, "chuong", "_c", "c_pos")
    out = out.select(*keep, "c_pos", *chapter, F.posexplode(c["dieu"]).alias("d_pos", "_a"))
    keep = [*keep, "c_pos", "d_pos", "c_so", "c_ten"]
    article = [a["dieu_so"].alias("a_so"), a["noi_dung"].alias("a_text"), a["page_number"].alias("a_page")]
    out = out.select(*keep, *article, F.posexplode_outer(a["khoan"]).alias("k_pos", "_k"))
    keep = [*keep, "k_pos", "a_so", "a_text", "a_page"]
    clause = [k["khoan_so"].alias("k_so"), k["noi_dung"].alias("k_text"), k["page_number"].alias("k_page"), k.isNull().alias("no_clause")]
    out = out.select(*keep, *clause, F.posexplode_outer(k["diem"]).alias("p_pos", "p"))
    return out.withColumn("no_point", F.col("p").isNull()).withColumn("at", F.struct("c_pos", "d_pos", "k_pos", "p_pos"))


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def chunk_leaf(docs: DataFrame) -> DataFrame:
    """(doc_id, at, text, van_ban, chuong, dieu, khoan, diem, source_file, page_number)."""
    title, article, clause, point = F.col("ten_van_ban"), F.col("a_so"), F.col("k_so"), F.col("p")
    lead = F.when(_some(F.col("k_text")) != "", F.concat(F.lit(" ("), F.col("k_text"), F.lit(")"))).otherwise(F.lit(""))
    text = (
        F.when(F.col("no_clause"), F.concat(F.lit("Theo Điều "), article, F.lit(" "), title, F.lit(" "), _some(F.col("a_text"))))
        .when(F.col("no_point"), F.concat(F.lit("Khoản "), clause, F.lit(" Điều "), article, F.lit(" "), title, F.lit(" "), _some(F.col("k_text"))))
        .otherwise(
            F.concat(
                F.lit("Tại điểm "), point["diem_ky_hieu"], F.lit(" Khoản "), clause, F.lit(" Điều "), article,
                F.lit(" "), title, lead, F.lit(" "), _some(point["noi_dung"]),
            )
        )
    )
    page = F.coalesce(point["page_number"], "k_page", "a_page")
    return _leaves(docs, ["doc_id", "ten_van_ban", "source_file"]).select(
        "doc_id", "at", text.alias("text"), title.alias("van_ban"), F.col("c_so").alias("chuong"), article.alias("dieu"),
        clause.alias("khoan"), point["diem_ky_hieu"].alias("diem"), "source_file", page.alias("page_number"),
    )


def chunk_typed(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, type, text, van_ban, chuong, dieu, khoan, diem, page_number): typed chunks, numbered per document."""
    m = F.col("metadata")
    fallback = F.concat(_some(m["loai_van_ban"]), F.lit(" "), _some(m["so_hieu"]))
    title = F.trim(F.when(_some(F.col("ten_van_ban")) != "", F.col("ten_van_ban")).otherwise(fallback))
    named = docs.withColumn("title", title)
    null = F.lit(None).cast("string")
    columns = ["doc_id", "part", "at", "type", "text", "title", "chuong", "dieu", "khoan", "diem", "page_number"]
    start = F.struct(*[F.lit(0).alias(x) for x in ("c_pos", "d_pos", "k_pos", "p_pos")])
    empty = [null.alias(x) for x in ("chuong", "dieu", "khoan", "diem")] + [F.lit(None).cast("int").alias("page_number")]
    head_text = F.concat(
        F.col("title"), F.lit("\nCơ quan ban hành: "), _some(m["co_quan_ban_hanh"]), F.lit("\nNgày ban hành: "), _some(m["ngay_ban_hanh"])
    )
    head = named.select("doc_id", F.lit(0).alias("part"), start.alias("at"), F.lit("metadata").alias("type"), strip(head_text).alias("text"), "title", *empty)
    basis = named.select("doc_id", "title", F.posexplode("can_cu_phap_ly").alias("i", "cc")).select(
        "doc_id", F.lit(1).alias("part"),
        F.struct(F.col("i").alias("c_pos"), F.lit(0).alias("d_pos"), F.lit(0).alias("k_pos"), F.lit(0).alias("p_pos")).alias("at"),
        F.lit("can_cu").alias("type"),
        F.concat(F.lit("Căn cứ "), (F.col("i") + 1).cast("string"), F.lit(" của "), F.col("title"), F.lit(": "), F.col("cc")).alias("text"),
        "title", *empty,
    )
    so, article, clause, point = F.col("c_so"), F.col("a_so"), F.col("k_so"), F.col("p")
    alone, plain = F.col("no_clause"), F.col("no_point")
    of = F.concat(F.lit(" của "), F.col("title"), F.lit(": "))
    prefix = (
        F.when(_some(so) == "", F.lit(""))
        .when(alone, F.concat(F.lit("Chương "), so, F.lit(" ("), _some(F.col("c_ten")), F.lit("). ")))
        .otherwise(F.concat(F.lit("Chương "), so, F.lit(". ")))
    )
    body = (
        F.when(alone, F.concat(F.lit("Theo Điều "), article, of, _some(F.col("a_text"))))
        .when(plain, F.concat(F.lit("Khoản "), clause, F.lit(", Điều "), article, of, _some(F.col("k_text"))))
        .otherwise(F.concat(F.lit("Tại điểm "), point["diem_ky_hieu"], F.lit(", Khoản "), clause, F.lit(", Điều "), article, of, _some(point["noi_dung"])))
    )
    kind = F.when(alone, F.lit("dieu")).when(plain, F.lit("khoan")).otherwise(F.lit("diem"))
    page = F.when(alone, F.col("a_page")).when(plain, F.col("k_page")).otherwise(point["page_number"])
    leaves = _leaves(named, ["doc_id", "title"]).select(
        "doc_id", F.lit(2).alias("part"), "at", kind.alias("type"), strip(F.concat(prefix, body)).alias("text"), "title",
        so.alias("chuong"), article.alias("dieu"), clause.alias("khoan"), point["diem_ky_hieu"].alias("diem"), page.alias("page_number"),
    )
    rows = head.select(*columns).unionByName(basis.select(*columns)).unionByName(leaves.select(*columns))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "at"))
    return rows.withColumn("chunk_no", number).withColumnRenamed("title", "van_ban").drop("part", "at")


def chunk_enrich(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Unique non-empty chunks of every document with the document's fields.

    ``chunks(doc_id, idx, text, ...)`` keep ``idx`` as chunk_index, counted before copies go.
    ``docs(doc_id, ...)`` is one row per document; both sides lie by doc_id after the window.
    """
    trimmed = chunks.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    first = W.partitionBy("doc_id", F.md5("text")).orderBy("idx")
    kept = trimmed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    out = kept.withColumnRenamed("idx", "chunk_index").withColumn("short", F.length("text") < 10)
    return out.join(docs, "doc_id")


def token_windows(texts: DataFrame, size: int = 254, overlap: int = 32) -> DataFrame:
    """(doc_id, window, start, stop, text): windows over whitespace tokens.

    A text that fits is one window; else windows start at every stride, the last ones
    too, even where the one before already reached the end.
    """
    stride = size - overlap
    n = F.size("toks")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    split = texts.select("doc_id", words(F.col("text")).alias("toks"))
    cut = unfold(split, ["doc_id", "toks"], starts, "start", "window")
    piece = F.slice("toks", F.col("start") + 1, F.lit(size))
    return cut.select(
        "doc_id", F.concat_ws("_", F.col("doc_id"), F.col("window")).alias("window_id"),
        F.col("start").cast("long").alias("start"), (F.col("start") + F.size(piece) - 1).cast("long").alias("stop"),
        F.array_join(piece, " ").alias("text"),
    )


def text_or_scan(pages: DataFrame) -> DataFrame:
    """(doc_id, chars, route, route_first): a document with little extractable text is a scan."""
    length = F.length(strip(F.coalesce(F.col("text"), F.lit(""))))
    out = pages.groupBy("doc_id").agg(
        F.sum(length).alias("chars"), F.coalesce(F.max(F.when(F.col("page_no") == 1, length)), F.lit(0)).alias("first")
    )
    return out.select(
        "doc_id", "chars", F.when(F.col("chars") < 100, F.lit("scan")).otherwise(F.lit("text")).alias("route"),
        F.when(F.col("first") > 50, F.lit("text")).otherwise(F.lit("scan")).alias("route_first"),
    )


def ingest_report(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, store: DataFrame) -> DataFrame:
    """One row per document: status, sizes, counts, warnings and errors.

    ``docs(doc_id, text, quality, gate)``, ``chunks(doc_id, text)``, ``vectors(doc_id, embedding)``,
    ``store(doc_id)``: all are reduced to one row per document before they meet.
    """
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("*").alias("num_chunks"), F.count_if(F.length(strip(F.col("text"))) < 10).alias("num_short")
    )
    dims = vectors.groupBy("doc_id").agg(F.max(F.size("embedding")).cast("long").alias("embedding_dim"))
    stored = store.groupBy("doc_id").agg(F.count("*").alias("stored_chunks"))
    out = docs.join(per_doc, "doc_id", "left").join(dims, "doc_id", "left").join(stored, "doc_id", "left")
    out = out.fillna(0, ["num_chunks", "num_short", "embedding_dim", "stored_chunks"])
    errors = F.array_compact(
        F.array(
            F.when(F.col("gate") != "accepted", F.concat(F.lit("text: "), F.col("gate"))),
            F.when(F.col("num_chunks") == 0, F.lit("no chunks")),
            F.when(F.col("stored_chunks") > 0, F.lit("duplicate document")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("quality") == "low", F.lit("no title")),
            F.when(F.col("num_short") > 0, F.concat(F.lit("short chunks: "), F.col("num_short").cast("string"))),
        )
    )
    return (
        out.withColumn("text_length", F.length("text").cast("long"))
        .withColumn("errors", errors)
        .withColumn("warnings", warnings)
        .withColumn("status", F.when(F.size("errors") > 0, F.lit("failed")).otherwise(F.lit("success")))
        .select("doc_id", "status", "text_length", "num_chunks", "embedding_dim", "stored_chunks", "warnings", "errors")
    )
