"""Citation columns: formats, extraction from answer text, match rule."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import any_of, naming, strip

TRIPLES = "array<struct<dieu:string,khoan:string,diem:string>>"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _part(label: str, c: Column) -> Column:
    return F.when(~blank(c), F.concat(F.lit(label + " "), c))


def citation(dieu: Column, khoan: Column, diem: Column) -> Column:
    text = F.concat_ws(", ", _part("Điều", dieu), _part("Khoản", khoan), _part("Điểm", diem))
    return F.when(text == "", F.lit("N/A")).otherwise(text)


def full_citation(van_ban: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    base = citation(dieu, khoan, diem)
    return F.when(blank(van_ban), base).otherwise(F.concat(base, F.lit(" - "), van_ban))


def display_citation(van_ban: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    base = citation(dieu, khoan, diem)
    return F.when(blank(van_ban) | (van_ban == "N/A"), base).otherwise(
        F.concat(F.lit("**"), van_ban, F.lit("**: "), base)
    )


def header(van_ban: Column, chuong: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    return F.concat(
        F.concat_ws(
            ", ",
            F.concat(F.lit("[VB: "), F.coalesce(van_ban, F.lit(""))),
            _part("Chương", chuong),
            _part("Điều", dieu),
            _part("Khoản", khoan),
            _part("Điểm", diem),
        ),
        F.lit("]"),
    )


def matches(
    dieu: Column, khoan: Column, diem: Column, e_dieu: Column, e_khoan: Column, e_diem: Column
) -> Column:
    """Citation against expectation: articles must both be there or both not, the finer
    parts count only where both have them, and something must have been compared."""
    both = lambda a, b: ~blank(a) & ~blank(b)
    same = lambda a, b: F.trim(a) == F.trim(b)
    article = (blank(dieu) & blank(e_dieu)) | (both(dieu, e_dieu) & same(dieu, e_dieu))
    fine = lambda a, b: ~both(a, b) | same(a, b)
    some = both(dieu, e_dieu) | both(khoan, e_khoan) | both(diem, e_diem)
    return F.coalesce(article & fine(khoan, e_khoan) & fine(diem, e_diem) & some, F.lit(False))


def _nullable(c: Column) -> Column:
    return F.when(c != "", c)


def extracted(text: Column) -> Column:
    """All citations in an answer text, as an array of (dieu, khoan, diem).

    The pieces between article mentions give every mention's position by running sum;
    clause and point are the first ones from 60 characters before to 100 after it.
    A text that names no article yields its distinct clauses.
    """
    found = F.struct(
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(V.ARTICLE_CITE), F.lit(0)).alias("mentions"),
        F.regexp_extract_all(text, F.lit(V.ARTICLE_CITE), F.lit(1)).alias("numbers"),
    )
    return naming(found, lambda f: F.when(F.size(f["mentions"]) > 0, _near_articles(f)).otherwise(_bare_clauses(f)))


def _near_articles(f: Column) -> Column:
    text = f["text"]
    sizes = F.zip_with(
        F.split(text, V.ARTICLE_CITE, -1), f["mentions"], lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
    )
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, s: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0)) + s["g"]
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + s["m"]).alias("stop"))))

    # the piece after the last mention has none beside it
    spans = F.aggregate(F.filter(sizes, lambda s: s["m"].isNotNull()), none, step)

    def one(number: Column, span: Column) -> Column:
        begin = F.greatest(F.lit(0), span["start"] - 60)
        near = F.substring(text, begin + 1, span["stop"] + 100 - begin)
        return F.struct(
            number.alias("dieu"),
            _nullable(F.regexp_extract(near, V.CLAUSE_CITE, 1)).alias("khoan"),
            _nullable(F.regexp_extract(near, V.POINT_CITE, 1)).alias("diem"),
        )

    return F.array_distinct(F.zip_with(f["numbers"], spans, one)).cast(TRIPLES)


def _bare_clauses(f: Column) -> Column:
    null = F.lit(None).cast("string")
    clauses = F.array_distinct(F.regexp_extract_all(f["text"], F.lit(V.CLAUSE_CITE), F.lit(1)))
    return F.transform(clauses, lambda k: F.struct(null.alias("dieu"), k.alias("khoan"), null.alias("diem"))).cast(TRIPLES)


def abstained(text: Column) -> Column:
    """The answer is a refusal, or short and carries a refusal phrase."""
    low = strip(F.lower(text))
    return F.coalesce(
        (low == "") | low.isin(V.REFUSALS) | ((F.length(low) < 200) & any_of(low, V.ABSTAIN_MARKERS)), F.lit(True)
    )


def conclusion(text: Column) -> Column:
    """Text under a conclusion heading, else before the citation list, else everything."""
    clean = F.regexp_replace(strip(text), r'^[:\s"]+', "")
    headed = F.regexp_extract(clean, V.CONCLUSION_PATTERN, 1)
    before = F.regexp_extract(clean, V.CITATION_HEADING, 1)
    return F.coalesce(
        F.when(clean.rlike(V.CONCLUSION_PATTERN), strip(headed)),
        F.when(clean.rlike(V.CITATION_HEADING), strip(before)),
        clean,
    )


ANSWER_SCHEMA = (
    "answer string, ket_luan string, tra_loi string, response string, abstain boolean, refusal string, "
    "reason string, ly_do string, citations string, trich_dan string"
)
CITATION_SCHEMA = (
    "struct<van_ban:string,dieu:string,khoan:string,diem:string,quoted_text:string,noi_dung:string>"
)


def _full(c: Column) -> Column:
    """Null for an empty string: the next alias is tried then."""
    return F.when(c != "", c)


def parsed_answer(raw: Column) -> Column:
    """struct(answer, citations, abstain, reason, is_json) from an answer's JSON, however wrapped."""
    fenced = _full(strip(F.regexp_extract(raw, r"```(?:json)?\s*\n?([\s\S]*?)```", 1)))
    braces = _full(F.regexp_extract(raw, r"\{[\s\S]*\}", 0))
    broken = F.concat(F.lit("{"), _full(F.regexp_extract(raw, r'"[a-zA-Z_]+"\s*:[\s\S]*\}', 0)))
    body = F.coalesce(fenced, braces, broken)
    body = F.when(strip(body).startswith("{"), body).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    data = F.from_json(body, ANSWER_SCHEMA)
    keys = F.json_object_keys(body)
    is_json = F.coalesce(F.size(keys) >= 0, F.lit(False))
    refused = F.coalesce(data["abstain"], F.lit(False)) | F.coalesce(F.array_contains(keys, "refusal"), F.lit(False))
    reason = F.coalesce(_full(data["reason"]), _full(data["ly_do"]), _full(data["refusal"]), F.lit(""))
    answer = F.when(refused, F.coalesce(_full(data["answer"]), reason)).otherwise(
        F.coalesce(_full(data["answer"]), _full(data["ket_luan"]), _full(data["tra_loi"]), data["response"])
    )
    listed = F.coalesce(_full(data["citations"]), _full(data["trich_dan"]))
    listed = F.when(strip(listed).startswith("{"), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed)
    rows = F.coalesce(F.from_json(listed, f"array<{CITATION_SCHEMA}>"), F.array().cast(f"array<{CITATION_SCHEMA}>"))
    kept = F.filter(rows, lambda c: ~(blank(c["van_ban"]) & blank(c["dieu"]) & blank(c["khoan"]) & blank(c["diem"])))
    shaped = F.transform(
        kept,
        lambda c: F.struct(
            F.coalesce(c["van_ban"], F.lit("")).alias("van_ban"),
            _full(c["dieu"]).alias("dieu"),
            _full(c["khoan"]).alias("khoan"),
            _full(c["diem"]).alias("diem"),
            F.coalesce(_full(c["quoted_text"]), c["noi_dung"]).alias("quoted_text"),
        ),
    )
    return F.struct(
        answer.alias("answer"),
        shaped.alias("citations"),
        (is_json & refused).alias("abstain"),
        F.when(refused, reason).alias("reason"),
        is_json.alias("is_json"),
    )
