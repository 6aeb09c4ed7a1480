"""Cleaning of pages and texts, document headers, noise, scope."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.keywords import strings
from statuta.functions.text import any_of, collapsed, naming, strip, weird_count


def clean_page(text: Column) -> Column:
    """Lines of a page, stripped, without page numbers, stubs and page headers."""
    lines = F.transform(F.split(text, "\n"), strip)
    keep = lambda x: ~x.rlike(r"^\d+$") & (F.length(x) >= 2) & ~x.rlike(V.PAGE_NOISE)
    return F.array_join(F.filter(lines, keep), "\n")


def merge_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_key, text)`` to one text per document, pages in numeric order.

    Pages are cleaned where they lie; one document's pages meet because its text is one value.
    """
    number = F.element_at(F.split("page_key", "_"), -1)
    page = F.struct(
        number.cast("int").alias("n"),
        F.concat(F.lit("\n[PAGE_"), number, F.lit("]\n"), clean_page(F.col("text"))).alias("text"),
    )
    return (
        pages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
        .select("doc_id", page.alias("page"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list("page")).alias("pages"))
        .select("doc_id", F.array_join(F.col("pages.text"), "\n\n").alias("text"), F.size("pages").cast("long").alias("n_pages"))
    )


def reading_order(boxes: DataFrame) -> DataFrame:
    """``boxes(page_id, y, x, text)`` to page texts, boxes top to bottom, then left to right."""
    return (
        boxes.filter(F.coalesce(F.col("text"), F.lit("")) != "")
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("boxes"))
        .select("page_id", F.array_join(F.col("boxes.text"), "\n").alias("text"))
    )


def text_gate(docs: DataFrame, terms: list[str] = V.GATE_TERMS, min_length: int = 500, min_terms: int = 2) -> DataFrame:
    """Add (found, status, warning): too short, too few domain terms, or accepted."""
    found = naming(F.lower("text"), lambda low: F.filter(strings(terms), lambda t: F.contains(low, t)))
    status = (
        F.when(F.length("text") < min_length, F.lit("too_short"))
        .when(F.size("found") < min_terms, F.lit("too_few_terms"))
        .otherwise(F.lit("accepted"))
    )
    return (
        docs.withColumn("found", found)
        .withColumn("status", status)
        .withColumn("no_page_marker", ~F.contains("text", F.lit("[PAGE_")))
    )


def _first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def issuing_body(text: Column) -> Column:
    """Nearest meaningful line among the three above the motto, within the first thirty lines."""
    lines = F.slice(F.split(text, r"\r\n|\r|\n"), 1, 30)
    is_motto = F.transform(lines, lambda x: any_of(x, V.MOTTOS))

    def above(row: Column) -> Column:
        at = F.array_position(row["flags"], True).cast("int")
        start = F.greatest(F.lit(1), at - 3)
        span = F.when(at > 1, F.slice(row["lines"], start, at - start)).otherwise(F.array().cast("array<string>"))
        good = F.filter(
            F.transform(F.reverse(span), strip),
            lambda x: ~x.isin(V.HEADER_BOILERPLATE) & ~any_of(x, V.HEADER_NOISE),
        )
        return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))

    return naming(F.struct(lines.alias("lines"), is_motto.alias("flags")), above)


def document_metadata(text: Column) -> Column:
    """struct(so_hieu, ngay_ban_hanh, loai_van_ban, co_quan_ban_hanh); the first match wins."""
    date = F.when(
        text.rlike(V.DATE_HEADER),
        F.concat_ws("/", *[_first_group(text, V.DATE_HEADER, g) for g in (1, 2, 3)]),
    ).otherwise(F.lit(""))
    kinds = [F.when(text.rlike(r"(?iU)\b" + t + r"\b"), F.lit(t)) for t in V.DOC_TYPES]
    return F.struct(
        _first_group(text, V.NUMBER_HEADER).alias("so_hieu"),
        date.alias("ngay_ban_hanh"),
        F.coalesce(*kinds, F.lit("")).alias("loai_van_ban"),
        issuing_body(text).alias("co_quan_ban_hanh"),
    )


def header_metadata_v2(text: Column) -> Column:
    """The same from the first fifty lines, where later lines overwrite earlier ones."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 50), strip)

    def last(pattern: str, value) -> Column:
        hits = F.filter(lines, lambda x: x.rlike(pattern))
        return F.coalesce(F.try_element_at(F.transform(hits, value), F.lit(-1)), F.lit(""))

    group = lambda p: lambda x: F.regexp_extract(x, p, 1)
    date = lambda x: F.concat_ws("/", *[F.regexp_extract(x, V.DATE_HEADER_V2, g) for g in (1, 2, 3)])
    issuer_hits = F.filter(lines, lambda x: any_of(x, V.ISSUER_MARKS_V2))
    issuer = F.transform(issuer_hits, lambda x: strip(F.replace(x, F.lit(V.ISSUER_MARKS_V2[0]), F.lit(""))))
    return F.struct(
        last(V.NUMBER_HEADER_V2, group(V.NUMBER_HEADER_V2)).alias("so_hieu"),
        last(V.TYPE_HEADER_V2, group(V.TYPE_HEADER_V2)).alias("loai_van_ban"),
        last(V.DATE_HEADER_V2, date).alias("ngay_ban_hanh"),
        F.coalesce(F.try_element_at(issuer, F.lit(-1)), F.lit("")).alias("co_quan_ban_hanh"),
    )


def noise_flags(chunks: DataFrame) -> DataFrame:
    """Add one flag per noise marker and ``is_weird``."""
    text = strip(F.col("text"))
    names = ["has_replacement", "has_box", "has_at"]
    out = chunks
    for name, marker in zip(names, V.NOISE_MARKERS):
        out = out.withColumn(name, F.contains(text, F.lit(marker)))
    return out.withColumn("is_weird", weird_count(text) > F.greatest(F.lit(20.0), F.length(text) * 0.05))


def out_of_scope(query: Column, keywords: list[str] = V.SCOPE_KEYWORDS, markers: list[str] = V.OUT_OF_SCOPE_MARKERS) -> Column:
    q = collapsed(query)
    return F.when(q == "", F.lit(True)).when(any_of(q, keywords), F.lit(False)).otherwise(any_of(q, markers))


def policy_violation(answer: Column, abstain: Column, n_citations: Column) -> Column:
    return (F.coalesce(answer, F.lit("")) != "") & ~abstain & (n_citations == 0)


def escalation(answer: Column, abstain: Column, n_citations: Column, error: Column) -> Column:
    """Reason to answer again with the stronger tier; null when the answer will do."""
    short = F.length(strip(F.coalesce(answer, F.lit("")))) < 20
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), F.left(error, F.lit(60))))
        .when(short, F.lit("answer empty/too short"))
        .when(F.contains(answer, F.lit("[Placeholder]")), F.lit("placeholder response"))
        .when(~abstain & (n_citations == 0), F.lit("no citations"))
    )
