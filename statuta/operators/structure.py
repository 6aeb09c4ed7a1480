"""Legal hierarchy of whole document tables: lines are classified, open nodes carried forward by windows.

``docs(doc_id, text)`` becomes ``lines(doc_id, pos, line)``; every window runs over one
document in line order, so the lines are shuffled once. A document is one text value, which
bounds the lines that meet in a task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import any_of, strip, words
from statuta.unfold import unfold


class _Order:
    """Windows over the lines of one document; built on use, as they need a session."""

    @property
    def doc(self):
        return W.partitionBy("doc_id").orderBy("pos")

    @property
    def upto(self):
        return self.doc.rowsBetween(W.unboundedPreceding, 0)

    @property
    def before(self):
        return self.doc.rowsBetween(W.unboundedPreceding, -1)

    # looking ahead is looking back over the lines in reverse: one pass, not one per line
    @property
    def from_here(self):
        return W.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)

    @property
    def later(self):
        return W.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)


ORDER = _Order()

# a point marker inside a line: text before it, letter, text after it; the three ways of
# the prefix are tried in the order in which a left-to-right search would find them
INLINE_POINT = r"^((?:[:;.]\s*)|(?:.{0,15}\s+)|(?:.*?[:;.]\s*))([a-zA-ZđĐ])\)\s+(.*)$"


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, line): stripped, none empty."""
    split = unfold(docs, ["doc_id"], F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x85  ]"), "line", "pos")
    return split.withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")


def group(line: Column, pattern: str, number: int) -> Column:
    return F.regexp_extract(line, pattern, number)


def is_appendix(line: Column) -> Column:
    return (
        line.rlike(V.APPENDIX_LINE)
        & (F.size(words(line)) <= 15)
        & ~any_of(F.lower(line), V.APPENDIX_REFERENCES)
    )


def is_reference(line: Column) -> Column:
    """A chapter line that only cites a chapter of some text."""
    return line.rlike(V.CHAPTER_LINE.replace("+)", "++)") + r"\s*(?:" + "|".join(V.CHAPTER_REFERENCE_WORDS) + ")")


def is_upper(line: Column) -> Column:
    return (line == F.upper(line)) & (line != F.lower(line))


def classify(lines: DataFrame) -> DataFrame:
    """Add one flag per kind of line and ``kind``, the first that holds."""
    line = F.col("line")
    flags = {
        "page": line.rlike(V.PAGE_MARKER_LINE),
        "number": line.rlike(V.NUMBER_LINE),
        "header_stop": line.rlike(V.HEADER_STOP_LINE),
        "doc_type": line.rlike(V.DOC_TYPE_LINE),
        "footer": line.rlike(V.FOOTER_LINE),
        "appendix": is_appendix(line),
        "chapter": line.rlike(V.CHAPTER_LINE) & ~is_reference(line),
        "chapter_reference": line.rlike(V.CHAPTER_LINE) & is_reference(line),
        "section": line.rlike(V.SECTION_LINE),
        "article": line.rlike(V.ARTICLE_LINE),
        "clause": line.rlike(V.CLAUSE_LINE),
        "point": line.rlike(V.POINT_LINE),
    }
    out = lines.withColumns({f"is_{k}": v for k, v in flags.items()})
    order = ["page", "number", "footer", "appendix", "chapter", "chapter_reference", "section", "article", "clause", "point", "header_stop", "doc_type"]
    kind = F.coalesce(*[F.when(F.col(f"is_{k}"), F.lit(k)) for k in order], F.lit("text"))
    return out.withColumn("kind", kind)


def marked(lines: DataFrame) -> DataFrame:
    """Lines that count, with page and whether the appendix part has begun."""
    page = F.when(F.col("is_page"), group(F.col("line"), V.PAGE_MARKER_LINE, 1).cast("int"))
    paged = classify(lines).withColumn("page", F.coalesce(F.last(page, ignorenulls=True).over(ORDER.upto), F.lit(1)))
    kept = paged.filter(~F.col("is_page") & ~F.col("is_number"))
    return kept.withColumn("in_appendix", F.max("is_appendix").over(ORDER.upto))


def with_title_parts(m: DataFrame) -> DataFrame:
    """Marked lines with their document's title lines, from the first document-type line to the end of the header."""
    body = ~F.col("in_appendix")
    finish = (F.col("is_header_stop") | F.col("is_chapter") | F.col("is_article")) & body
    whole = W.partitionBy("doc_id")
    bounds = m.withColumns(
        {
            "finish": F.min(F.when(finish, F.col("pos"))).over(whole),
            "foot": F.min(F.when(F.col("is_footer") & body, F.col("pos"))).over(whole),
            "start": F.min(F.when(F.col("is_doc_type"), F.col("pos"))).over(whole),
        }
    )
    end = F.coalesce(F.col("finish"), F.col("foot") + 1)
    part = (F.col("pos") >= F.col("start")) & (F.col("pos") < end) & ~F.col("line").rlike(V.HEADER_TRASH_LINE)
    return bounds.withColumn("title_parts", F.collect_list(F.when(part, F.struct("pos", "line"))).over(whole)).drop("finish", "foot", "start")


def title_of(parts: Column) -> Column:
    title = F.array_join(F.array_sort(parts)["line"], " ")
    return F.when(title == "", F.lit(V.UNKNOWN_TITLE)).otherwise(title).alias("ten_van_ban")


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, ten_van_ban) of every document with lines."""
    return with_title_parts(marked(lines)).groupBy("doc_id").agg(F.first("title_parts").alias("parts")).select("doc_id", title_of(F.col("parts")))


def appendices(lines: DataFrame) -> DataFrame:
    """(doc_id, number, tieu_de, noi_dung): every line after a header belongs to the latest one."""
    m = marked(lines).filter("in_appendix").withColumn("number", F.sum(F.col("is_appendix").cast("long")).over(ORDER.upto))
    return (
        m.groupBy("doc_id", "number")
        .agg(
            F.max(F.when(F.col("is_appendix"), F.col("line"))).alias("tieu_de"),
            F.array_sort(F.collect_list(F.when(~F.col("is_appendix"), F.struct("pos", "line")))).alias("body"),
        )
        .select("doc_id", "number", "tieu_de", F.col("body.line").alias("noi_dung"))
    )


def inline_point(text: Column) -> Column:
    """struct(prefix, letter, rest) of a marker inside the text; letter is null without one."""
    hit = F.contains(text, F.lit(")")) & text.rlike(INLINE_POINT)
    part = lambda n: F.when(hit, group(text, INLINE_POINT, n))
    return F.struct(part(1).alias("prefix"), part(2).alias("letter"), F.trim(part(3)).alias("rest"))


def _items(lines: DataFrame, titled: bool = False) -> DataFrame:
    """One row per line piece with its kind and the open chapter, article and clause; ``titled`` adds the document's title lines."""
    m = marked(lines)
    m = (with_title_parts(m) if titled else m).filter(~F.col("in_appendix"))
    line = F.col("line")
    # chapter names: first upper-case line of a chapter, up to a footer
    seg = F.sum((F.col("is_chapter") | F.col("is_footer")).cast("long")).over(ORDER.upto)
    m = m.withColumn("seg", seg)
    in_seg = W.partitionBy("doc_id", "seg").orderBy("pos")
    of_chapter = F.first("is_chapter").over(in_seg)
    may_name = ~F.col("is_chapter") & ~F.col("is_footer") & ~F.col("is_chapter_reference") & is_upper(line) & (F.length(line) > 5)
    m = m.withColumn("may_name", of_chapter & may_name)
    nth = F.sum(F.col("may_name").cast("int")).over(in_seg.rowsBetween(W.unboundedPreceding, 0))
    m = m.withColumn("is_name", F.col("may_name") & (nth == 1))
    name = F.max(F.when(F.col("is_name"), line)).over(W.partitionBy("doc_id", "seg"))
    m = m.withColumn("chapter_name", F.coalesce(name, F.lit("")))
    # open chapter and article
    opens = ~F.col("is_footer") & ~F.col("is_chapter") & ~F.col("is_chapter_reference") & ~F.col("is_name") & ~F.col("is_section")
    article = opens & F.col("is_article")
    chapter_event = F.when(
        F.col("is_chapter"),
        F.struct(group(line, V.CHAPTER_LINE, 1).alias("so"), F.col("chapter_name").alias("ten"), F.col("seg").alias("n")),
    ).when(
        F.col("is_footer") | (F.col("pos") < 0),
        F.struct(F.lit(None).cast("string").alias("so"), F.lit(None).cast("string").alias("ten"), F.col("seg").alias("n")),
    )
    article_event = F.when(article, group(line, V.ARTICLE_LINE, 1)).when(F.col("is_chapter") | F.col("is_footer"), F.lit(""))
    m = m.withColumns({"chapter_at": F.last(chapter_event, ignorenulls=True).over(ORDER.upto), "article_at": F.last(article_event, ignorenulls=True).over(ORDER.upto)})
    m = m.withColumns(
        {
            "chuong": F.coalesce(F.col("chapter_at.so"), F.lit(V.DEFAULT_CHAPTER)),
            "chuong_ten": F.coalesce(F.col("chapter_at.ten"), F.lit(V.DEFAULT_CHAPTER_NAME)),
            "in_article": F.coalesce(F.col("article_at"), F.lit("")) != "",
        }
    )
    clause = opens & ~F.col("is_article") & F.col("is_clause") & F.col("in_article")
    point = opens & ~F.col("is_article") & ~clause & F.col("is_point") & F.col("in_article")
    node = (
        F.when(F.col("is_footer"), F.lit("footer"))
        .when(F.col("is_chapter"), F.lit("chapter"))
        .when(F.col("is_chapter_reference"), F.lit("reference"))
        .when(F.col("is_name") | F.col("is_section"), F.lit("skip"))
        .when(article, F.lit("article"))
        .when(clause, F.lit("clause"))
        .when(point, F.lit("point"))
        .otherwise(F.lit("text"))
    )
    m = m.withColumn("node", node)
    path = lambda khoan: F.struct(F.col("chuong").alias("chuong"), F.col("chuong_ten").alias("chuong_ten"), F.col("article_at").alias("dieu"), khoan.alias("khoan"))
    clause_event = F.when(F.col("node") == "clause", path(group(line, V.CLAUSE_LINE, 1))).when(
        F.col("node") == "article", path(F.lit(None).cast("string"))
    )
    m = m.withColumn("clause_at", F.last(clause_event, ignorenulls=True).over(ORDER.upto))
    has_clause = F.col("clause_at.khoan").isNotNull()
    # pieces: the line itself, and a point found inside it
    own = (
        F.when(F.col("node") == "article", group(line, V.ARTICLE_LINE, 2))
        .when(F.col("node") == "clause", group(line, V.CLAUSE_LINE, 2))
        .when(F.col("node") == "point", group(line, V.POINT_LINE, 2))
        .otherwise(line)
    )
    m = m.withColumn("own", F.trim(own))
    m = m.withColumn("inline", F.when((F.col("node") == "clause") | ((F.col("node") == "text") & has_clause), inline_point(F.col("own"))))
    before = F.col("inline.prefix")
    lead = F.when(
        F.col("node") == "clause",
        F.trim(F.regexp_replace(F.left(before, F.length(before) - 1), r"[:;.]\s*$", "")),
    ).otherwise(F.trim(before))
    letter = F.when(F.col("node") == "point", group(line, V.POINT_LINE, 1))
    piece = lambda sub, node_, text, diem: F.struct(F.lit(sub).alias("sub"), node_.alias("node"), text.alias("content"), diem.alias("diem"))
    first = piece(0, F.col("node"), F.when(F.col("inline.letter").isNull(), F.col("own")).otherwise(lead), letter)
    second = F.when(F.col("inline.letter").isNotNull(), piece(1, F.lit("inline_point"), F.col("inline.rest"), F.col("inline.letter")))
    kept = ["doc_id", "pos", "page", "chuong", "chuong_ten", "article_at", "clause_at", *(["title_parts"] if titled else [])]
    return m.select(*kept, F.explode(F.array_compact(F.array(first, second))).alias("piece")).select(*kept, "piece.*")


def _noded(lines: DataFrame, titled: bool = False) -> DataFrame:
    """Pieces with the number of the node they belong to and whether that node is kept."""
    order = W.partitionBy("doc_id").orderBy("pos", "sub").rowsBetween(W.unboundedPreceding, 0)
    opening = F.col("node").isin("footer", "chapter", "article", "clause", "point", "inline_point")
    items = _items(lines, titled).filter("node <> 'skip'").withColumn("opens", opening)
    items = items.withColumn("node_id", F.sum(F.col("opens").cast("long")).over(order))
    attached = F.col("node").isin("article", "clause", "inline_point") | ((F.col("node") == "point") & F.col("clause_at.khoan").isNotNull())
    return items.withColumn("keeps", F.last(F.when(F.col("opens"), attached), ignorenulls=True).over(order))


def parse(lines: DataFrame, titled: bool = False) -> DataFrame:
    """(doc_id, node_id, level, chuong, chuong_ten, dieu, khoan, diem, page_number, noi_dung) in reading order.

    ``titled`` adds ten_van_ban, from the same pass over the lines.
    """
    kept = _noded(lines, titled).filter(F.coalesce(F.col("keeps"), F.lit(False)))
    by_clause = F.col("node").isin("clause", "point", "inline_point")
    head = F.struct(
        F.when(F.col("node") == "inline_point", F.lit("point")).otherwise(F.col("node")).alias("level"),
        F.when(by_clause, F.col("clause_at.chuong")).otherwise(F.col("chuong")).alias("chuong"),
        F.when(by_clause, F.col("clause_at.chuong_ten")).otherwise(F.col("chuong_ten")).alias("chuong_ten"),
        F.when(by_clause, F.col("clause_at.dieu")).otherwise(F.col("article_at")).alias("dieu"),
        F.when(by_clause, F.col("clause_at.khoan")).alias("khoan"),
        F.col("diem"),
        F.col("page").alias("page_number"),
    )
    grouped = kept.groupBy("doc_id", "node_id").agg(
        F.max(F.when(F.col("opens"), head)).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("pos", "sub", "content")))).alias("parts"),
        *([F.first("title_parts").alias("title_parts")] if titled else []),
    )
    title = [title_of(F.col("title_parts"))] if titled else []
    return grouped.select("doc_id", "node_id", "head.*", F.array_join(F.col("parts.content"), " ").alias("noi_dung"), *title)


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, content, reason): text that no kept node holds."""
    rest = _noded(lines).filter(~F.coalesce(F.col("keeps"), F.lit(False)) & ~F.col("node").isin("chapter", "footer"))
    reason = F.when(F.col("node") == "point", F.lit("point without clause")).otherwise(F.lit("no open node"))
    return rest.select("doc_id", "pos", "content", reason.alias("reason"))


def parse_quality(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ten_van_ban, quality, n_chapters, warning) for every document."""
    chapters = parse(lines).groupBy("doc_id").agg(F.count_distinct("chuong").alias("n_chapters"))
    out = docs.select("doc_id").join(titles(lines), "doc_id", "left").join(chapters, "doc_id", "left")
    out = out.fillna({"ten_van_ban": V.UNKNOWN_TITLE, "n_chapters": 0})
    return out.withColumn("quality", F.when(F.col("ten_van_ban") == V.UNKNOWN_TITLE, F.lit("low")).otherwise(F.lit("high"))).withColumn(
        "warning", F.when(F.col("n_chapters") == 0, F.lit("no chapters")).otherwise(F.lit(""))
    )


# ---- the flat parser --------------------------------------------------------


def parse_flat(lines: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, dieu, khoan, diem, tieu_de, noi_dung).

    Text after a node waits; when a later node may take it over, it replaces the text of the
    node before that one. What waits at the end of the file is appended to the last node.
    """
    line = F.col("line")
    is_article = line.rlike(V.FLAT_ARTICLE_LINE)
    article = F.last(F.when(is_article, group(line, V.FLAT_ARTICLE_LINE, 1)), ignorenulls=True).over(ORDER.upto)
    m = lines.withColumns({"is_article": is_article, "dieu": article})
    is_clause = ~F.col("is_article") & line.rlike(V.FLAT_CLAUSE_LINE) & F.col("dieu").isNotNull()
    m = m.withColumn("is_clause", is_clause)
    clause_event = F.when(F.col("is_article"), F.lit("")).when(F.col("is_clause"), group(line, V.FLAT_CLAUSE_LINE, 1))
    m = m.withColumn("khoan", F.last(clause_event, ignorenulls=True).over(ORDER.upto))
    is_point = ~F.col("is_article") & ~F.col("is_clause") & line.rlike(V.FLAT_POINT_LINE) & (F.coalesce(F.col("khoan"), F.lit("")) != "")
    level = F.when(F.col("is_article"), 1).when(F.col("is_clause"), 2).when(is_point, 3)
    m = m.withColumn("level", level).withColumn("node_id", F.sum(F.col("level").isNotNull().cast("long")).over(ORDER.upto))
    # the node after a node decides whether it takes the waiting text
    m = m.withColumn("next", F.last("level", ignorenulls=True).over(ORDER.later))
    takes = F.col("next").isNull() | (F.col("next") == 1) | ((F.col("next") == 2) & (F.col("level") >= 2)) | ((F.col("next") == 3) & (F.col("level") == 3))
    m = m.withColumn("takes", F.when(F.col("level").isNotNull(), takes))
    # text of a node goes to that node if it takes, else to the first later one that does
    m = m.withColumns(
        {
            "here": F.last("takes", ignorenulls=True).over(ORDER.upto),
            "ahead": F.last(F.when(F.col("takes"), F.col("node_id")), ignorenulls=True).over(ORDER.from_here),
        }
    )
    nodes = m.filter("level is not null")
    text = m.filter("level is null").select(
        "doc_id", "pos", "line", F.when(F.col("here"), F.col("node_id")).otherwise(F.col("ahead")).alias("node_id")
    )
    waiting = text.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("w"))
    waiting = waiting.select("doc_id", "node_id", F.array_join(F.col("w.line"), " ").alias("waiting"))
    content = (
        F.when(F.col("level") == 1, F.lit(""))
        .when(F.col("level") == 2, group(line, V.FLAT_CLAUSE_LINE, 2))
        .otherwise(group(line, V.FLAT_POINT_LINE, 2))
    )
    final = (
        F.when(F.col("waiting").isNull(), F.col("own"))
        .when(F.col("next").isNull(), F.concat("own", F.lit(" "), "waiting"))
        .otherwise(F.col("waiting"))
    )
    return (
        nodes.withColumn("own", F.trim(content))
        .withColumn("diem", F.when(F.col("level") == 3, group(line, V.FLAT_POINT_LINE, 1)))
        .withColumn("tieu_de", F.when(F.col("level") == 1, F.trim(group(line, V.FLAT_ARTICLE_LINE, 2))))
        .join(waiting, ["doc_id", "node_id"], "left")
        .select(
            "doc_id", "node_id", F.element_at(F.array(*map(F.lit, ("article", "clause", "point"))), F.col("level")).alias("level"),
            "dieu", F.when(F.col("level") >= 2, F.col("khoan")).alias("khoan"), "diem", "tieu_de", final.alias("noi_dung"),
        )
    )


# ---- the second parser ------------------------------------------------------


def _basis(lines: DataFrame) -> DataFrame:
    """Lines with whether they belong to a legal-basis block, which only a plain line ending in ';' closes."""
    line = F.col("line")
    starts = line.rlike(V.V2_BASIS_LINE)
    ends = line.endswith(";")
    state = F.last(F.when(starts, 1).when(ends, 0), ignorenulls=True).over(ORDER.before)
    m = lines.withColumn("is_basis", starts | (F.coalesce(state, F.lit(0)) == 1))
    return m.withColumn("closes", F.col("is_basis") & ~starts & ends)


def basis_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, number, text) of the closed legal-basis blocks."""
    m = _basis(lines).filter("is_basis")
    m = m.withColumn("number", F.coalesce(F.sum(F.col("closes").cast("long")).over(ORDER.before), F.lit(0)) + 1)
    blocks = m.groupBy("doc_id", "number").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"), F.max("closes").alias("closed")
    )
    return blocks.filter("closed").select("doc_id", "number", F.array_join(F.col("b.line"), " ").alias("text"))


def parse_v2(lines: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, chuong, dieu, khoan, diem, noi_dung); for chapters and articles the text is their title.

    Every node gathers the lines after it. A chapter that follows directly takes away what a
    node gathered, and leaves an open point behind that swallows text until the next point.
    """
    line = F.col("line")
    m = _basis(lines).filter(~F.col("is_basis"))
    is_chapter = line.rlike(V.V2_CHAPTER_LINE)
    like_article = ~is_chapter & line.rlike(V.V2_ARTICLE_LINE)
    cited = like_article & F.trim(group(line, V.V2_ARTICLE_LINE, 2)).rlike(V.V2_REFERENCE)
    m = m.withColumns({"is_chapter": is_chapter, "is_cited": cited, "is_article": like_article & ~cited})
    chapter_event = F.when(F.col("is_chapter"), group(line, V.V2_CHAPTER_LINE, 1))
    article_event = F.when(F.col("is_chapter"), F.lit("")).when(F.col("is_article"), group(line, V.V2_ARTICLE_LINE, 1))
    m = m.withColumns({"chuong": F.coalesce(F.last(chapter_event, ignorenulls=True).over(ORDER.upto), F.lit("")), "dieu": F.last(article_event, ignorenulls=True).over(ORDER.upto)})
    free = ~F.col("is_chapter") & ~F.col("is_cited") & ~F.col("is_article")
    m = m.withColumn("is_clause", free & line.rlike(V.V2_CLAUSE_LINE) & (F.coalesce(F.col("dieu"), F.lit("")) != ""))
    clause_event = F.when(F.col("is_chapter") | F.col("is_article"), F.lit("")).when(F.col("is_clause"), group(line, V.V2_CLAUSE_LINE, 1))
    m = m.withColumns(
        {
            "khoan": F.last(clause_event, ignorenulls=True).over(ORDER.upto),
            "part": F.sum((F.col("is_chapter") | F.col("is_article") | F.col("is_clause")).cast("long")).over(ORDER.upto),
        }
    )
    may_point = free & ~F.col("is_clause") & line.rlike(V.V2_POINT_LINE) & (F.coalesce(F.col("khoan"), F.lit("")) != "")
    letter = group(line, V.V2_POINT_LINE, 1)
    in_part = W.partitionBy("doc_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("lettered", may_point & (letter != "1"))
    m = m.withColumn("is_point", F.col("lettered") | (may_point & F.coalesce(F.max("lettered").over(in_part), F.lit(False))))
    level = F.when(F.col("is_chapter"), 1).when(F.col("is_article"), 2).when(F.col("is_clause"), 3).when(F.col("is_point"), 4)
    m = m.withColumn("level", level)
    m = m.withColumns(
        {
            "node_id": F.sum(F.col("level").isNotNull().cast("long")).over(ORDER.upto),
            "before": F.last("level", ignorenulls=True).over(ORDER.before),
            "at": F.last("level", ignorenulls=True).over(ORDER.upto),
        }
    )
    stale = F.last(F.when((F.col("level") == 1) & (F.col("before") == 4), True).when(F.col("level") == 4, False), ignorenulls=True).over(ORDER.upto)
    m = m.withColumn("stale", F.coalesce(stale, F.lit(False)))
    gathered = (
        F.col("level").isNull()
        & F.col("at").isNotNull()
        & ~((F.col("at") == 3) & F.col("stale"))
        & ~((F.col("at") == 1) & F.col("is_cited"))
    )
    head_text = (
        F.when(F.col("level") == 1, group(line, V.V2_CHAPTER_LINE, 2))
        .when(F.col("level") == 2, group(line, V.V2_ARTICLE_LINE, 2))
        .when(F.col("level") == 3, group(line, V.V2_CLAUSE_LINE, 2))
        .when(F.col("level") == 4, group(line, V.V2_POINT_LINE, 2))
    )
    content = F.when(F.col("level").isNotNull(), F.trim(head_text)).when(gathered, line)
    diem = F.when(F.col("level") == 4, F.when(letter == "1", F.lit("l")).otherwise(letter))
    head = F.struct(
        F.col("level"), F.col("chuong"), F.when(F.col("level") >= 2, F.col("dieu")).alias("dieu"),
        F.when(F.col("level") >= 3, F.col("khoan")).alias("khoan"), diem.alias("diem"), F.trim(head_text).alias("own"),
    )
    nodes = (
        m.filter(F.col("node_id") > 0)
        .groupBy("doc_id", "node_id")
        .agg(
            F.max(F.when(F.col("level").isNotNull(), head)).alias("head"),
            F.array_sort(F.collect_list(F.when(content != "", F.struct("pos", content.alias("text"))))).alias("parts"),
        )
        .select("doc_id", "node_id", "head.*", F.array_join(F.col("parts.text"), " ").alias("all_text"))
    )
    following = F.lead("level").over(W.partitionBy("doc_id").orderBy("node_id"))
    nodes = nodes.withColumn("following", following)
    text = (
        F.when((F.col("level") == 1) & (F.coalesce(F.col("following"), F.lit(1)) == 1), F.lit(""))
        .when((F.col("level") == 2) & (F.col("following") == 1), F.lit(""))
        .when(F.col("following") == 1, F.col("own"))
        .otherwise(F.col("all_text"))
    )
    names = F.array(*map(F.lit, ("chapter", "article", "clause", "point")))
    return nodes.select("doc_id", "node_id", F.element_at(names, F.col("level")).alias("level"), "chuong", "dieu", "khoan", "diem", text.alias("noi_dung"))
