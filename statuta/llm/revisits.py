"""Resolution of not-modified revisit records of web archives.

A record is a full response or a revisit (the server answered "not modified", so no body was stored). A revisit is resolved by an as-of
join: of the responses with the same canonical URL, the latest one before it. The entity tags of both have to agree (weak
comparison), or, where one has none, the dates of last modification; where neither can be compared the revisit is ``unchecked``. A
resolved record has the response's headers, with those headers of the revisit put over them that a not-modified answer may change.

One URL may own a large part of all records. So records are first cut into ranges of (URL, date, kind, id); within a range each URL's
latest response so far is a running value, and what comes from ranges before is a running value over one row for each range and URL.

Defined cases: a null or empty URL, or a null date, resolves nothing (``missing``); at equal dates responses stand before revisits, and of
several responses the one of the largest id counts; repeated rows are resolved one by one; null headers are empty ones; header
names compare in lower case, and of names equal in it the value of the last by name counts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.session import stored

#: Headers of a not-modified answer that describe the missing body or the connection, and so never replace stored ones.
KEPT = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-connection te trailer transfer-encoding upgrade"
).split()
TRACKING = r"(?<=[?&])(utm_[a-z]+|gclid|fbclid)=[^&]*&?"


def canonical(url: Column) -> Column:
    """A URL without scheme, user, ``www.``, default port, fragment, tracking parameters and closing slash, its host in lower case."""
    rest = F.regexp_replace(F.trim(url), "(?i)^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    tail = F.substr(rest, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_replace(tail, TRACKING, ""), "[?&]$", "")
    return F.concat(host, F.regexp_replace(tail, "/$", ""))


def _lower_names(headers: Column) -> Column:
    """Headers with lower-case names, one value a name."""
    sorted_ = F.array_sort(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(
        sorted_,
        empty,
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The stored headers, with the permitted ones of a not-modified answer over them."""
    fresh = F.map_filter(_lower_names(fresh), lambda k, _: ~k.isin(KEPT))
    old = F.map_filter(_lower_names(stored_headers), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(old, fresh)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row for every revisit.

    ``records``: record_id long, url string, date timestamp, kind string (``response`` or ``revisit``), etag string, last_modified string,
    headers map<string, string>. Gives record_id, url_key, response_id, verdict (``resolved``, ``mismatch``, ``unchecked`` or ``missing``)
    and headers, which are null unless the verdict is ``resolved`` or ``unchecked``.
    """
    key = F.when(F.col("date").isNotNull(), F.nullif(canonical(F.col("url")), F.lit("")))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", key.alias("url_key"), "date", (F.col("kind") == "revisit").alias("late"), "etag", "last_modified", "headers")
    # rows without a key stay apart from one another: they only pass through
    order = ["url_key", "date", "late", "record_id"]
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "records")

    full = F.when(~F.col("late"), F.struct("record_id", "etag", "last_modified", "headers"))
    there = ranged.filter(F.col("url_key").isNotNull())
    inside = W.partitionBy("url_key", "_part").orderBy("date", "late", "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = there.withColumn("_near", F.last(full, ignorenulls=True).over(inside)).filter("late")
    ends = there.filter(~F.col("late")).groupBy("url_key", "_part").agg(F.max(F.struct("date", "record_id")).alias("_end"))
    ends = there.filter(~F.col("late")).join(ends, ["url_key", "_part"]).filter((F.col("date") == F.col("_end.date")) & (F.col("record_id") == F.col("_end.record_id")))
    ends = ends.groupBy("url_key", "_part").agg(F.first(F.struct("record_id", "etag", "last_modified", "headers")).alias("_far"))
    # one row a range and URL: a URL has as many as ranges it spans
    spans = near.select("url_key", "_part").distinct().join(ends, ["url_key", "_part"], "full")
    before = W.partitionBy("url_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_far", F.last("_far", ignorenulls=True).over(before))
    found = near.join(spans, ["url_key", "_part"], "left").withColumn("_hit", F.coalesce("_near", "_far"))

    tag, old_tag = _weak(F.col("etag")), _weak(F.col("_hit.etag"))
    both_tags = F.col("etag").isNotNull() & F.col("_hit.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("_hit.last_modified").isNotNull()
    same = F.when(both_tags, tag == old_tag).when(both_dates, F.trim("last_modified") == F.trim("_hit.last_modified"))
    verdict = F.when(F.col("_hit").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("verdict", verdict)
    headers = F.when(F.col("verdict").isin("resolved", "unchecked"), merged_headers(F.col("_hit.headers"), F.col("headers")))
    out = found.select("record_id", "url_key", F.col("_hit.record_id").alias("response_id"), "verdict", headers.alias("headers"))
    lost = ranged.filter(F.col("url_key").isNull() & F.col("late"))
    none = F.lit(None)
    return out.unionByName(lost.select("record_id", "url_key", none.cast("long").alias("response_id"), F.lit("missing").alias("verdict"), none.cast("map<string,string>").alias("headers")))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response; ``bodies``: record_id and any further columns."""
    rows = bodies.withColumnRenamed("record_id", "response_id")
    return resolved.filter(F.col("verdict").isin("resolved", "unchecked")).join(rows, "response_id")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from raw pages, so that the operator has work that grows with them.

    Each page is a response. A revisit follows a day later, with the page's tag, or another one for every fifth page, or with a date only
    for every third. Every seventh page was also asked for a day before its response.
    """
    day = F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.col("page_id"), F.lit(1000)) * 60)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    tag, modified = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("d"), (F.col("page_id") % 400).cast("string"))
    third, fifth = F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0
    none = F.lit(None).cast("string")
    pages = pages.filter(F.col("page_id").isNotNull())

    def record(number: int, days: int, kind: str, etag: Column, headers: Column) -> DataFrame:
        return pages.select(
            (F.col("page_id") * 4 + number).alias("record_id"),
            "url",
            (day + F.make_interval(days=F.lit(days))).alias("date"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            modified.alias("last_modified"),
            headers.alias("headers"),
        )

    stored_ = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    fresh = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 90).cast("string")), F.lit("Age"), F.lit("1"))
    asked = F.when(third, none).when(fifth, F.lit("other")).otherwise(F.concat(F.lit("W/"), tag))
    early = record(2, -1, "revisit", tag, fresh).filter(F.expr("(record_id - 2) div 4 % 7 = 0"))
    return record(0, 0, "response", tag, stored_).unionByName(record(1, 1, "revisit", asked, fresh)).unionByName(early)


def digest(pages: DataFrame) -> DataFrame:
    """Resolution of the pages' captures, headers as one line."""
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return resolve(captures(pages)).select("record_id", "url_key", "response_id", "verdict", line.alias("headers"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(strlen(html), 0) AS size, md5(coalesce(html, '')) AS tag, 'd' || (page_id % 400) AS modified,
    1600000000 + (page_id % 1000) * 60 AS ts
  FROM pages WHERE page_id IS NOT NULL
),
r AS (
  SELECT page_id * 4 AS record_id, page_id, url, ts, 0 AS late, tag AS etag, modified, size FROM p
  UNION ALL
  SELECT page_id * 4 + 1, page_id, url, ts + 86400, 1, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'other' ELSE tag END, modified, size FROM p
  UNION ALL
  SELECT page_id * 4 + 2, page_id, url, ts - 86400, 1, tag, modified, size FROM p WHERE page_id % 7 = 0
),
cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM r
),
halves AS (SELECT *, lower(regexp_extract(rest, '^[^/?]*')) AS host, substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS tail FROM cut),
k AS (
  SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '^www[0-9]*[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(tail, '([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*&?', '\1', 'g'), '[?&]$', ''), '/$', ''), '') AS url_key
  FROM halves
),
best AS (
  SELECT v.*, s.record_id AS response_id, s.etag AS old_tag, s.modified AS old_modified, s.size AS old_size,
    row_number() OVER (PARTITION BY v.record_id ORDER BY s.ts DESC NULLS LAST, s.record_id DESC) AS n
  FROM k v LEFT JOIN k s ON s.late = 0 AND s.url_key = v.url_key AND s.ts <= v.ts
  WHERE v.late = 1
),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
    WHEN CASE WHEN etag IS NOT NULL AND old_tag IS NOT NULL THEN etag = old_tag ELSE modified = old_modified END THEN 'resolved'
    ELSE 'mismatch' END AS verdict
  FROM best WHERE n = 1
)
SELECT record_id, url_key, response_id, verdict, CASE WHEN verdict = 'resolved' THEN
  'age: 1; cache-control: max-age=' || (page_id % 90) || '; content-length: ' || old_size || '; content-type: text/html' END AS headers
FROM judged
"""
