"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a canonical URL, host and path; it fits its host and all subdomains where the path starts with the rule's, and the longest
rule wins. Every URL is expanded to the keys that a rule of the list could have: a host suffix of as many labels as some rule has,
with a path prefix as long as that rule's. The filter (512-bit blocks, one bit in each of eight words) drops nearly all keys that are
not listed; the join with the rules drops the rest.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule but one with an empty host; of rules with
equal keys ``block`` counts; between rules of equal length the smaller text wins; repeated rows are judged one by one; an empty list
gives every URL the default verdict; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.joins import BROADCAST_ROWS, within
from statuta.llm.words import mix

BITS_PER_KEY = 16
#: Blocks of the filter at most (64 bytes each); a longer list has more false hits, which the join removes.
MOST_BLOCKS = 1 << 18
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block, and for each of its eight words the bit, of every hash."""
    h = mix(hashes.view(np.uint64))
    block = (h & np.uint64(blocks - 1)).astype(np.int64)
    bits = mix(h[:, None] + (np.arange(1, 9, dtype=np.uint64) << np.uint64(32))) >> np.uint64(58)
    return block, np.uint64(1) << bits


def bloom(rules: DataFrame, count: int) -> np.ndarray:
    """Blocked Bloom filter of the column ``hash``: blocks x 8 words. The driver gets the blocks, at most ``MOST_BLOCKS``."""
    blocks = 1
    while blocks * 512 < count * BITS_PER_KEY and blocks < MOST_BLOCKS:
        blocks *= 2
    words = [f"w{i}" for i in range(8)]

    def run(batches):
        for batch in batches:
            block, bit = _places(batch.column("hash").to_numpy(), blocks)
            yield pa.record_batch([pa.array(block), *(pa.array(bit[:, i].view(np.int64)) for i in range(8))], ["block", *words])

    rows = rules.select("hash").mapInArrow(run, "block long, " + ", ".join(f"{w} long" for w in words))
    found = rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toArrow()
    out = np.zeros((blocks, 8), np.uint64)
    out[found["block"].to_numpy()] = np.stack([found[w].to_numpy() for w in words], 1).view(np.uint64)
    return out


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``rules``: (host, path, action)."""
    rules = rules.select("host", "path", "action").filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "action", F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("length"))
    rules = rules.withColumn("hash", F.xxhash64("rule"))
    # as many rows as there are kinds of rules: labels x path lengths
    shapes = [tuple(r) for r in rules.select("labels", "length").distinct().orderBy("labels", "length").collect()]
    blocks = bloom(rules, rules.count())

    host, path = parts_of(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", "[.]"))
    fits = [F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in shapes]
    rows = rows.withColumn("keys", F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>"))
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def probe(batches):
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            block, bit = _places(hashes.flatten().to_numpy(), len(blocks))
            hit = ((blocks[block] & bit) == bit).all(1)
            counts = np.diff(hashes.offsets.to_numpy())
            passed = np.bincount(np.repeat(np.arange(batch.num_rows), counts)[hit], minlength=batch.num_rows)
            possible = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(passed)]).astype(np.int32)), keys.flatten().filter(pa.array(hit)))
            yield pa.record_batch([*(batch.column(c) for c in ("_row", "_key", "host", "path")), possible], ["_row", "_key", "host", "path", "possible"])

    kind = pages.schema[key].dataType.simpleString()
    passed = rows.mapInArrow(probe, f"_row long, _key {kind}, host string, path string, possible array<string>")
    # a row without a possible hit gets a key of its own, so such rows do not meet
    one = passed.select("_row", "_key", "host", "path", F.explode_outer("possible").alias("possible"))
    one = one.withColumn("_rule", F.coalesce("possible", F.concat(F.lit("\n"), F.col("_row").cast("string"))))
    listed = rules.select(F.col("rule").alias("_rule"), F.struct((-F.length("rule")).alias("order"), "rule", "action").alias("fit"))
    listed = F.broadcast(listed) if within(listed, BROADCAST_ROWS) else listed
    best = one.join(listed, "_rule", "left").groupBy("_row").agg(F.first("_key").alias(key), F.first("host").alias("host"), F.first("path").alias("path"), F.min("fit").alias("fit"))
    return best.select(key, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
),
ruled AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
