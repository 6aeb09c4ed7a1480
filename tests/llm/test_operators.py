"""Whole operators: brute force on the smallest tables, planted cases, and odd tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from statuta.llm import bagminhash, decontamination, language, packing, quality, queries, revisits, sharding, topk, toxicity, urlrules
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 120_000

#: Nulls, empty and very long texts, ties, repeated rows, extra columns whose names the operators use inside.
ODD = [
    (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "a b c d e f g h", None, None, 5), (3, "a b c d e f g h", None, None, 5), (4, "!!! ???", "en", "s", 7),
    (5, "a b c d e f g h", "de", "t", 9), (None, "a b c d e f g h", "en", "t", 9), (6, LONG, "en", "s", 3), (7, LONG + "amet", "en", "s", 3), (8, "!!! ???", "en", "s", 7),
    (None, None, None, None, None), (9, "über ñandú", "es", "u", 1), (10, "x", "fr", "u", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "label", "_key", "key", "head", "n", "shard", "size", "rep", "lead_id", "lead_rows", "_salt", "length", "ids", "bands", "_rows", "_class", "role", "letters"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (5, 1, None), (6, 1, 0), (7, None, 0), (None, 1, 1), (9, 1, 1), (9, 1, 1), (10, 2, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("extra"))


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def crc(key):
    return zlib.crc32(str(key).encode())


# ---- registered queries -------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES.keys() - {"pipeline"}))
def test_sql_twin(spark, name):
    ok, message = compare(spark, connect(FOLDER), name, FOLDER, queries.QUERIES, queries.ORACLES)
    assert ok, message


def test_one_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES if q != "pipeline"} == set(range(1, 14)) and "pipeline" in queries.QUERIES


# ---- keys that are no plain numbers -------------------------------------------


A = "one two three four five six seven eight nine ten eleven twelve"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_are_rows_not_ids(spark, kind):
    """Ids that unlike texts share: each text stays; ids of text."""
    rows = [(1, A), (1, B), (2, "quite another text with some other words in it here"), (3, A + "."), (3, B), (4, B), (None, A), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("row", F.lit("extra")).withColumn("row_number", F.lit("extra"))
    k = int if kind == "long" else str
    got = Counter((r["doc_id"], r["class_id"]) for r in bagminhash.classes(docs).collect())
    assert got == Counter({(k(1), k(1)): 2, (k(2), k(2)): 1, (k(3), k(1)): 2, (k(4), k(1)): 1, (None, None): 1, (k(5), k(5)): 1})
    kept = bagminhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("1", A), ("1", B), ("2", rows[2][1]), ("None", A), ("5", "")])


def test_decontamination_of_text_keys(spark):
    docs = spark.createDataFrame([("x1", "so " + A + " end"), ("x2", B)], "doc_id string, text string")
    items = spark.createDataFrame([("i", A)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, items).collect()] == [("x1", "i")]
    assert decontamination.matches(docs, items.limit(0)).collect() == []


# ---- language -----------------------------------------------------------------


def test_language_held_out(spark):
    docs = table(spark, "documents", LARGER)
    got = queries.QUERIES["op1_language"](spark, LARGER).toPandas()
    rows = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (rows.held_out == [crc(i) % 4 == 2 for i in rows.doc_id]).all() and len(rows) == docs.count()
    held = rows[rows.held_out & rows.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd(odd, none):
    got = {r["doc_id"]: r for r in language.classify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and got[2]["score"] == 0
    assert {got[i]["lang_pred"] for i in (3, 6, 9)} <= {"en", "de", "es", "fr"} and language.classify(odd).count() == len(ODD)
    assert language.classify(none).collect() == []
    unknown = language.classify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


# ---- packing ------------------------------------------------------------------


def test_packing_round_trip(spark):
    docs = table(spark, "documents")
    loaded = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, ids=True).toPandas()
    texts = dict(docs.select("doc_id", "text").collect())
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        ids = np.concatenate(list(own.ids))
        assert ids.tolist() == loaded.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in own.ids]
    assert set(rows.doc_id) == set(texts)
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and sorted(fill.index) == list(range(len(fill)))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    assert len(fill) <= -(-fill.sum() // 2048) + 2


def test_packing_odd(odd, none):
    rows = packing.pack(odd, PATH, window=16).toPandas()
    assert rows[rows.doc_id == 2][["length", "doc_tokens"]].values.tolist() == [[1, 1]]
    assert len(rows[rows.doc_id == 3]) == 2 and rows.doc_id.isna().sum() == 2
    assert rows.length.sum() == rows[rows.start == 0].doc_tokens.sum() and (rows.start == 0).sum() == len(ODD)
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 16 and sorted(fill.index) == list(range(len(fill)))
    assert packing.pack(none, PATH).collect() == []


# ---- revisits -----------------------------------------------------------------


def test_revisits(spark):
    at = "timestamp'2024-01-0{} 00:00:00'".format
    rows = [
        # a hot URL written in many ways
        (1, "http://www.A.com/x/", 1, "response", "t1", None, "map('Content-Type', 'text/html', 'X', '1')"),
        (2, "https://a.com:443/x#f", 2, "revisit", "W/t1", None, "map('x', '2', 'content-length', '0')"),
        (3, "https://a.com/x?utm_source=f", 3, "revisit", "t2", None, "null"),
        (4, "a.com/x", 4, "response", None, "m", "null"),
        (5, "http://a.com/x", 4, "revisit", None, "m", "null"),
        (6, "http://a.com/x", 5, "revisit", "t1", None, "null"),
        (7, "http://b.com/x", 5, "revisit", "t1", None, "null"),
        (8, None, 5, "revisit", "t1", None, "null"),
        (2, "https://a.com:443/x#f", 2, "revisit", "W/t1", None, "map('x', '2', 'content-length', '0')"),
    ]
    text = lambda v: "cast(null as string)" if v is None else f"'{v}'"
    sql = " union all ".join(
        f"select {i}L record_id, {text(u)} url, {at(d)} date, '{k}' kind, {text(e)} etag, {text(m)} last_modified, cast({h} as map<string,string>) headers, 'extra' verdict" for i, u, d, k, e, m, h in rows
    )
    records = spark.sql(sql)
    got = sorted((r["record_id"], r["response_id"], r["verdict"], sorted((r["headers"] or {}).items())) for r in revisits.resolve(records).collect())
    resolved = (2, 1, "resolved", [("content-type", "text/html"), ("x", "2")])
    assert [g[:3] for g in got] == [r[:3] for r in (resolved, resolved)] + [(3, 1, "mismatch"), (5, 4, "resolved"), (6, 4, "unchecked"), (7, None, "missing"), (8, None, "missing")]
    assert got[0][3] == resolved[3]
    assert revisits.resolve(records.limit(0)).collect() == []
    bodies = spark.createDataFrame([(1, "body")], "record_id long, body string")
    assert {r["body"] for r in revisits.with_bodies(revisits.resolve(records), bodies).collect()} == {"body"}


def test_revisits_over_many_ranges(spark):
    """One URL over all ranges: responses every tenth record."""
    records = spark.range(3000).select(
        F.col("id").alias("record_id"), F.lit("http://a.com/").alias("url"), F.timestamp_seconds("id").alias("date"), F.when(F.col("id") % 10 == 0, "response").otherwise("revisit").alias("kind"),
        F.lit("t").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    got = revisits.resolve(records)
    assert got.count() == 2700 and got.filter("response_id != record_id div 10 * 10 or verdict != 'resolved'").count() == 0


# ---- decontamination ----------------------------------------------------------


def contained(docs, items):
    def runs(text):
        w = words(text)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    of = {i: runs(t) for i, t in items.items() if t}
    out = set()
    for doc, text in docs:
        own = runs(text or "")
        out |= {(doc, i) for i, r in of.items() if r and len(r & own) >= 0.8 * len(r)}
    return out


def test_decontamination_brute_force(spark, monkeypatch):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    rows = docs.select("doc_id", "text").collect()
    want = contained(rows, dict(items.select("item_id", "text").collect()))
    got = decontamination.matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0
    monkeypatch.setattr(decontamination, "PASS_ITEMS", 9)  # several passes
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, items).collect()} == want
    kept = {r["doc_id"] for r in decontamination.clean(docs, items).collect()}
    assert kept == {r["doc_id"] for r in rows} - {d for d, _ in want}


def test_decontamination_finds_edited_and_cut_copies(spark):
    """Every copy with one word changed, and every copy cut off at either end, that keeps 0.8 of the item's shingles; no other."""
    items = dict(table(spark, "benchmark").orderBy("item_id").limit(12).collect())
    copies = []
    for text in items.values():
        parts = text.split()
        copies += [" ".join([*parts[:k], "changed", *parts[k + 1 :]]) for k in range(len(parts))]
        copies += [" ".join(cut) for k in range(1, len(parts) // 3) for cut in (parts[:-k], parts[k:])]
    rows = [(i, "before it " + text + " and after") for i, text in enumerate(copies)]
    want = contained(rows, items)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontamination.matches(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(rows) > len(want) > 100
    assert any(r["answer_overlap"] < 0.5 for r in got) and all(r["score"] <= 1 + 1e-6 for r in got)
    assert {r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()} == set(range(len(rows))) - {d for d, _ in want}


def test_decontamination_of_items_with_few_heavy_words(spark):
    """Copies that lack just the two words that tell the items apart."""
    common = " ".join(f"w{i}" for i in range(13))
    items = {i: f"{common} rare{i} last{i}" for i in range(40)}
    rows = [(0, common), (1, common.removesuffix(" w12")), (2, items[7])]
    want = contained(rows, items)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and {d for d, _ in want} == {0, 2}
    assert all(abs(r["score"] - 1) < 1e-6 for r in got if r["doc_id"] == 2 and r["item_id"] == 7) and all(r["score"] < 0.6 for r in got if r["doc_id"] == 0)


def test_decontamination_of_short_items(spark, tmp_path):
    """Items of one to four words count where all their words follow one another; the query and the pipeline search for them."""
    items = [(1, "quick brown"), (2, "Fox!"), (3, "a b c d"), (4, ""), (5, "one two three four five six"), (6, None), (7, "?!")]
    docs = [(1, "the Quick, brown dog"), (2, "brown quick"), (3, "x a b c d y fox"), (4, "a b d c"), (5, "one two three four five six"), (6, "quick red brown")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (3, 2), (3, 3), (5, 5)] and all(abs(r["score"] - 1) < 1e-6 for r in got)
    kept = corpus_pipeline.decontaminated(spark, table(spark, "documents", str(tmp_path)), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6]


def test_retrieval_is_complete(spark):
    """Block-max pruning loses no passage and item that reach the threshold."""
    import pyarrow as pa

    from statuta.llm.words import word_hashes

    index = decontamination.indexes(table(spark, "benchmark"))[0]
    texts = [r["text"] or "" for r in table(spark, "documents").select("text").limit(80).collect()]
    hashes, cuts = word_hashes(pa.array(texts))
    got = {(t, f, i): s for t, f, i, s in zip(*(x.tolist() for x in index.retrieve(hashes, cuts, 0.3)))}
    n, impact = len(index.items), dict(zip(index.postings.tolist(), index.impacts.tolist()))
    number = {int(t): k for k, t in enumerate(index.terms)}
    want = {}
    for t in range(len(texts)):
        own = hashes[cuts[t] : cuts[t + 1]].tolist()
        for first in range(0, max(1, len(own)), index.stride):
            terms = {number[h] for h in own[first : first + 2 * index.stride] if h in number}
            for i in range(n):
                s = sum(impact.get(k * n + i, 0.0) for k in terms)
                if s >= 0.3:
                    want[t, first, i] = s
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, "a b"), (None, "x y z u v w"), (5, "ipsum dolor sit amet lorem ipsum")], "item_id long, text string").withColumn("doc_id", F.lit("extra"))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.matches(odd, items).collect())
    assert got == {(3, 1): 2, (3, 2): 2, (5, 1): 1, (5, 2): 1, (None, 1): 1, (None, 2): 1, (6, 5): 1, (7, 5): 1}
    kept = decontamination.clean(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 4, 8, 9, 10]
    assert decontamination.matches(none, items).collect() == [] and decontamination.matches(odd, items.limit(0)).collect() == []


# ---- top-k --------------------------------------------------------------------


def nearest_brute(ids, rows, k=5):
    out = []
    for i, q in zip(ids, rows):
        if i % 50 == 0:
            best = sorted((-int(s), int(j)) for s, j in zip(rows @ q, ids) if j != i)[:k]
            out += [(int(i), n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [60, 4096])
def test_topk_brute_force(spark, shard_rows):
    vectors = table(spark, "embeddings")
    rows = vectors.toPandas()
    want = nearest_brute(rows.vec_id.to_numpy(), np.floor(256 * np.stack(rows.embedding).astype(float)))
    got = topk.nearest(vectors, F.col("id") % 50 == 0, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-0.001, 0.0]), (50, [1.0]), (None, [1.0, 0.0]), (100, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("extra")).withColumn("v", F.lit("extra"))
    got = sorted(tuple(r) for r in topk.fiftieth(vectors).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 100, 0), (0, 5, 7, -256)]
    assert [g for g in got if g[0] == 50] == [] and len(got) == 10
    assert topk.fiftieth(vectors.limit(0)).collect() == []


def test_topk_of_repeated_ids(spark):
    """Unlike vectors of one id are rows of their own: each asks, and each is a candidate of the other."""
    vectors = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.fiftieth(vectors).select("query_id", "rank", "vec_id", "score").collect())
    one, two = [(50, 1, 1, 65536), (50, 2, 50, 0)], [(50, 1, 1, 131072), (50, 2, 50, 0)]
    assert got == sorted(one + two)


# ---- URL rules ----------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://a.NET/x?q", "https://sub.example.net/en/1", "http://example.net/fr/1", "http://badexample.com/de/", "http://example.com/de/x#y", "x.org/fr/", "ftp://x.org/fr/", "http://org/fr",
        "http://example.net", None, "", "://", "http://a.net/", "http://a.net/",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/")], "page_id long, url string").select("*", *[F.lit("extra").alias(c) for c in ("host", "path", "rule", "keys", "_row")])
    rules = spark.createDataFrame(urlrules.RULES + [("net", "/", "allow")], "host string, path string, action string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == (None, "allow") and got[4] == ("example.com", "/de/x", "example.com/de/", "block") and got[5][:2] == ("", "")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow") and got[8] == ("example.net", "", None, "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12] == got[13] == got[None]
    assert urlrules.judge(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    pages, rules = table(spark, "pages"), spark.createDataFrame(urlrules.RULES, "host string, path string, action string")
    want = sorted(map(str, urlrules.judge(pages, rules).collect()))
    monkeypatch.setattr(urlrules, "within", lambda df, n: False)
    assert sorted(map(str, urlrules.judge(pages, rules).collect())) == want


def test_bloom_filter_has_no_false_negative(spark):
    rules = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    blocks = urlrules.bloom(rules, 5000)

    def share(df):
        block, bit = urlrules._places(df.toPandas().iloc[:, 0].to_numpy(), len(blocks))
        return ((blocks[block] & bit) == bit).all(1).mean()

    assert share(rules) == 1 and share(spark.range(10_000, 30_000).select(F.xxhash64("id"))) < 0.01


# ---- toxicity and quality -----------------------------------------------------


@pytest.mark.parametrize("name, column, parts, threshold, least", [("op7_toxicity", "toxic", 5, 0.5, 0.9), ("op10_quality", "quality", 5, 0.3, 0.95)])
def test_classifiers_held_out(spark, name, column, parts, threshold, least):
    got = queries.QUERIES[name](spark, LARGER).toPandas()
    assert len(got) == 1000 and (got.held_out == [crc(i) % parts == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= threshold)).all() and got.score.between(0, 1).all()
    rows = got[got.held_out].merge(table(spark, "labels", LARGER).toPandas(), on="doc_id")
    assert (rows.predicted == rows[column]).mean() > least


@pytest.mark.parametrize("classify, accepted", [(toxicity.classify, toxicity.accepted), (quality.classify, quality.accepted)])
def test_classifiers_odd(odd, none, labels, classify, accepted):
    got = classify(odd, labels).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert got[got.doc_id == 3].score.nunique() == 1 and set(got[got.doc_id.isin([1, 2])].score.round(12)) == set(got[got.doc_id == 2].score.round(12))
    assert classify(none, labels).collect() == []
    flat = classify(odd, labels.limit(0)).toPandas()
    assert flat.score.nunique() == 1
    kept = accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)


def test_toxic_passages(spark):
    """Planted passages are found where they are, and clean documents have none."""
    clean = ["the of and in is it that " * 20 + f"calm{i} words" for i in range(300)]
    toxic = [t + " awful rotten fools " + t for t in clean[:60]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).toPandas()
    assert (got.predicted == (got.doc_id >= 300)).all()
    found = toxicity.passages(docs, labels).toPandas()
    assert set(found.doc_id) == set(range(300, 360)) and ((found.first_word == 142) & (found.last_word == 144)).all()


# ---- sharding -----------------------------------------------------------------


def test_sharding(spark):
    docs = table(spark, "documents")
    got = sharding.assign(docs).toPandas()
    texts = dict(docs.select("doc_id", "text").collect())
    assert sorted(got.doc_id) == sorted(texts) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for row in got.itertuples():
        data = (texts[row.doc_id] or "").encode()
        assert row.size == len(data) + 16 and row.text_crc32 == zlib.crc32(data)
    counts = got.groupby("shard").slot.agg(["count", "max", "min", "nunique"])
    assert sorted(counts.index) == list(range(40)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] == counts["count"] - 1).all() and (counts["min"] == 0).all() and (counts["nunique"] == counts["count"]).all()


def test_sharding_prunes(spark):
    """A shard covers few sources: fewer than a cut in any order would."""
    docs = table(spark, "documents", LARGER)
    got = sharding.placed(docs, carry=["lang", "source", "n_chars"]).toPandas()
    spread = got.groupby("shard").n_chars.agg(lambda x: np.log(x.max() + 1) - np.log(x.min() + 1)).mean()
    assert spread < 0.75 * (np.log(got.n_chars.max() + 1) - np.log(got.n_chars.min() + 1)) and got.groupby("shard").source.nunique().mean() < 0.6 * got.source.nunique()


def test_sharding_prunes_columns_of_few_values(spark):
    docs = table(spark, "documents", LARGER)
    got = sharding.placed(docs, carry=["lang"]).toPandas()
    assert got.lang.nunique() == 4 and got.groupby("shard").lang.nunique().mean() < 2


@pytest.mark.parametrize("sources", [20, 400])
def test_sharding_by_whole_strings(spark, sources):
    """Sources that only differ far behind their common beginning."""
    docs = spark.createDataFrame([(i, f"text {i}", f"https://example.org/source/{i % sources:03d}") for i in range(2000)] + [(2000, "none", None)], "doc_id long, text string, source string")
    got = sharding.placed(docs, dimensions=["source"], shards=20, carry=["source"]).toPandas()
    assert len(got) == 2001 and got.curve.nunique() == min(sources, 64) and got.curve.max() == 63
    assert got.groupby("shard").source.nunique().max() <= sources // 20 + 2 * -(-sources // 64)
    assert got.dropna().sort_values("source").curve.is_monotonic_increasing and got[got.source.isna()].curve.item() == 0


def test_sharding_odd(spark, odd, none, tmp_path):
    got = sharding.assign(odd).toPandas()
    assert len(got) == len(ODD) and sorted(got.shard) == sorted(r * 40 // len(ODD) for r in range(len(ODD)))
    assert set(got[got.doc_id == 2]["size"]) == {16} and set(got[got.doc_id == 2].text_crc32) == {0}
    assert sharding.assign(none).collect() == []
    sharding.write_shards(odd, str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ODD) and back.select("row.*").columns == odd.columns and back.select("shard").distinct().count() == 3


# ---- near-duplicates ----------------------------------------------------------


def near_brute(docs):
    bags = {}
    for doc, text in docs:
        w = words(text)
        bags[doc] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({text: 1})
    parent = {d: d for d in bags}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(bags)
    for i, a in enumerate(order):
        for b in order[:i]:
            common = sum((bags[a] & bags[b]).values())
            if common and common >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in bags}


def test_near_duplicates_brute_force(spark):
    docs = table(spark, "documents")
    want = near_brute(docs.select("doc_id", "text").collect())
    assert dict(bagminhash.classes(docs).select("doc_id", "class_id").collect()) == want and len(set(want.values())) < len(want)
    kept = bagminhash.first_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_duplicates_in_hot_buckets(spark, monkeypatch):
    """Chains of near copies and a passage that all share, with buckets that count as large at once."""
    monkeypatch.setattr(bagminhash, "SIDE", 5)
    monkeypatch.setattr(bagminhash, "TOGETHER", 8)
    random = np.random.default_rng(4)
    shared = [f"p{i}" for i in range(60)]
    rows, doc = [], 0
    for family in range(6):
        own = [f"f{family}w{i}" for i in range(60)]
        for _ in range(8):
            rows.append((doc, " ".join(shared + own)))
            own = list(own)
            own[int(random.integers(60))] = f"x{doc}"  # drifts away link by link
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(bagminhash.classes(docs).select("doc_id", "class_id").collect()) == near_brute(rows)


def test_unspaced_scripts(spark):
    """A near copy, and a test item inside a document, of a text without spaces."""
    random = np.random.default_rng(6)
    text = "".join(chr(c) for c in random.integers(0x4E00, 0x9000, 200))
    docs = spark.createDataFrame([(1, text), (2, text[:100] + "字" + text[101:]), (3, text[:60]), (4, "“other—words”")], "doc_id long, text string")
    assert dict(bagminhash.classes(docs).select("doc_id", "class_id").collect()) == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(9, text[10:40])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, items).collect()} == {(1, 9), (2, 9), (3, 9)}


def test_near_duplicates_odd(odd, none):
    got = Counter((r["doc_id"], r["class_id"]) for r in bagminhash.classes(odd).collect())
    assert got == {(1, 1): 1, (2, 2): 1, (3, 3): 2, (4, 4): 1, (5, 3): 1, (None, None): 2, (6, 6): 1, (7, 6): 1, (8, 4): 1, (9, 9): 1, (10, 10): 1}
    kept = bagminhash.first_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 9, 10]
    assert bagminhash.classes(none).collect() == [] and bagminhash.first_of_each(none).collect() == []


# ---- pipeline -----------------------------------------------------------------


def test_pipeline_against_its_parts(spark, tmp_path):
    """The stages' decisions on their own input, by the definitions above."""
    docs, n = table(spark, "documents"), {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, FOLDER)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        n[name] = kept.count()
        rows = before.select("doc_id", "text").collect()
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name != "packing":
            assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0
        if name == "near_dedup":
            assert ids == set(near_brute(rows).values())
        if name == "decontamination":
            assert ids == {r["doc_id"] for r in rows} - {d for d, _ in contained(rows, dict(table(spark, "benchmark").select("item_id", "text").collect()))}
        if name == "packing":
            assert ids == {r["doc_id"] for r in rows}
    assert n["quality"] < docs.count() and corpus_pipeline.run(spark, FOLDER).count() == n["packing"]
