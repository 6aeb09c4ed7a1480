"""What must not grow faster than the tables: time, memory and shuffles of single steps."""
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import tokens
from statuta.operators import matching as M
from statuta.operators import retrieval as R
from statuta.session import stored
from statuta.streaming import flows as L


def test_token_runs_are_the_token_pattern(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": [f"x{chr(i)}y" for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]}))
    found = lambda pattern: F.regexp_extract_all("c", F.lit(pattern), F.lit(0))
    assert df.filter(found(V.VI_TOKEN_RUNS) != found(V.VI_TOKEN_PATTERN)).isEmpty()


def test_tokens_take_time_like_a_plain_class(spark):
    text = F.repeat(F.concat(F.lit("lorem ipsum dolor "), F.col("id").cast("string")), F.lit(200))
    df = spark.range(400).select(text.alias("text"))

    def seconds(column):
        runs = []
        for _ in range(3):
            start = time.monotonic()
            df.agg(F.sum(F.size(column))).collect()
            runs.append(time.monotonic() - start)
        return min(runs)

    assert seconds(tokens(F.col("text"))) < 4 * seconds(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))) + 0.2


def test_duplicate_check_brute_force(spark):
    rng = random.Random(5)
    pick = lambda values: rng.choice([*values, None])
    store = [(pick("abc"), pick("uvwxyz")) for _ in range(80)]
    files = [(i, pick("abcd"), pick("uvwxyzq")) for i in range(60)]
    got = M.duplicate_check(spark.createDataFrame(files * 2, "file_id long, doc_id string, sha256 string"), spark.createDataFrame(store, "doc_id string, sha256 string"))
    same = lambda a, b: a is not None and a == b
    want = {f: sum(same(d, x) or same(s, y) for x, y in store) for f, d, s in files}
    rows = got.collect()
    assert len(rows) == 2 * len(files) and all(r["stored_chunks"] == want[r["file_id"]] and r["already_exists"] == (want[r["file_id"]] > 0) for r in rows)


def test_duplicate_check_of_one_large_document(spark):
    n = 30_000  # every file against every content would be 900 million rows
    files = spark.range(n).select(F.col("id").alias("file_id"), F.lit("d").alias("doc_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("sha256"))
    store = spark.range(n).select(F.lit("d").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sha256"))
    start = time.monotonic()
    assert M.duplicate_check(files, store).filter(F.col("stored_chunks") == n).count() == n
    assert time.monotonic() - start < 60


def test_found_terms_are_looked_up_in_slices():
    batch = pa.record_batch([pa.array(range(1000))], ["chunk_id"])
    assert [p.num_rows for p in R._slices([batch, batch.slice(0, 3), batch.slice(0, 0)])] == [256, 256, 256, 232, 3]


def test_best_holds_few_scores_at_once():
    rng = np.random.default_rng(1)
    queries, vectors = rng.normal(size=(200, 8)), rng.normal(size=(20_000, 8))
    pdf = pd.DataFrame({"chunk_id": np.arange(len(vectors)), "embedding": list(vectors)})
    tracemalloc.start()
    try:
        got = R._best(np.arange(200), queries, [pdf.iloc[:12_000], pdf.iloc[:0], pdf.iloc[12_000:]], 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25_000_000
    scores = np.round(queries @ vectors.T, 9)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert (got["chunk_id"].to_numpy().reshape(200, 5) == want).all()


def test_progress_stream_of_very_many_documents(spark, tmp_path):
    n = 40_000  # a call of Python for each would take minutes
    rows = spark.range(2 * n).select(
        F.when(F.col("id") % 97 > 0, F.col("id") % n).alias("doc_id"), F.when(F.col("id") % 89 > 0, F.timestamp_seconds("id")).alias("ts"), F.col("id").alias("line_no"),
        F.element_at(F.array(*map(F.lit, ["Parse", "noise", "Merging", "Step 1: x", " "])), (F.col("id") % 5 + 1).cast("int")).alias("line"),
    )
    for part in range(2):
        rows.filter(F.pmod(F.xxhash64("line_no"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = time.monotonic()
    L.run_available(L.progress_stream(lines, 16), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert time.monotonic() - start < 60
    out = spark.read.schema(L._PROGRESS).parquet(str(tmp_path / "out"))
    timed = rows.filter("ts is not null")
    assert out.count() == rows.filter("line <> ' '").count()
    assert L.settled(out.filter("ts is not null")).exceptAll(L.progress_batch(timed)).isEmpty()


def test_texts_are_shuffled_and_not_their_terms(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "b b"), (None, "a c"), (3, None)], "chunk_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = R.postings(chunks)
    assert sorted(map(tuple, got.filter("chunk_id is not null").collect())) == [(1, 3, "a", 2), (1, 3, "b", 1), (2, 2, "b", 3), (2, 2, "c", 1)]
    written = {}

    def keep(df, name):
        written[name] = df
        return df

    monkeypatch.setattr(R, "stored", keep)
    R.tfidf_scores(chunks, spark.createDataFrame([(1, "aa bb")], "query_id long, query string"))
    for df in (got, written["ngrams"]):
        # from the top: what cuts the texts comes after their one exchange
        assert plan(df).count("Exchange hashpartitioning") == 1 and plan(df).index("Generate") < plan(df).index("Exchange hashpartitioning")


def _cosines(chunks, queries, min_df, max_df):
    """{(query, chunk): score} by the definition; texts of one id are one document, as are those without."""
    def counts(rows):
        out = {}
        for key, text in rows:
            words = re.findall(r"\w{2,}", (text or "").lower())
            out.setdefault(key, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        return out

    docs, n = counts(chunks), len(chunks)
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + x)) + 1 for t, x in df.items() if min_df <= x <= max_df * n}
    weigh = lambda c: {t: (1 + math.log(x)) * idf[t] for t, x in c.items() if t in idf}
    unit = lambda w: {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    vectors = {k: unit(weigh(c)) for k, c in docs.items() if k is not None}
    asked = {k: unit(weigh(c)) for k, c in counts(queries).items() if k is not None}
    return {(q, c): sum(x * v[t] for t, x in a.items() if t in v) for q, a in asked.items() for c, v in vectors.items() if a.keys() & v.keys()}


def _texts(rng, n, ids):
    line = lambda: rng.choice(" ,.-").join(rng.choice("aa bb cc dd ee Ff g hh ii ÄÖ".split()) for _ in range(rng.randrange(9)))
    return [(rng.choice(ids), rng.choice([None, ""] + ["\n".join(line() for _ in range(rng.randrange(1, 5))) for _ in range(9)])) for _ in range(n)]


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_tfidf_brute_force(spark, monkeypatch, kind):
    rng = random.Random(3)
    ids = [None, *(f"c{i}" if kind == "string" else i for i in range(40))]
    chunks, queries = _texts(rng, 60, ids), _texts(rng, 12, [None, *range(8)])
    monkeypatch.setattr(R, "LEAST_CHARACTERS", 300)  # several parts and buckets
    frames = [spark.createDataFrame(rows, f"{key} {t}, {text} string") for rows, key, t, text in ((chunks, "chunk_id", kind, "text"), (queries, "query_id", "long", "query"))]
    want = _cosines(chunks, queries, 2, 0.6)
    ranked = {q: sorted((-round(s, 9), c) for (a, c), s in want.items() if a == q)[:3] for q, _ in want}
    for terms, fold in ((R.PASS_TERMS, R.N.FOLD_BYTES), (20, 1)):
        monkeypatch.setattr(R, "PASS_TERMS", terms)
        monkeypatch.setattr(R, "PASS_PAIRS", terms)
        monkeypatch.setattr(R.N, "FOLD_BYTES", fold)
        got = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.tfidf_scores(*frames, max_df=0.6).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        top = R.tfidf_topk(*frames, 3, max_df=0.6).collect()
        assert {q: [r["chunk_id"] for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == q] for q in ranked} == {q: [c for _, c in x] for q, x in ranked.items()}


def test_counted_parts_fold_as_they_go(monkeypatch):
    rng, lines = random.Random(1), []
    schema = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("body", pa.string()), ("counts", pa.binary()), ("chunks", pa.list_(pa.int64())), ("sizes", pa.binary()), ("numbers", pa.binary()), ("tfs", pa.binary())])
    for text in range(30):
        chunk = rng.choice([1, 2, 3, None])
        lines += [(chunk, i, "\n".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.choice([0, 0, 1, 4])))) for i in range(rng.randrange(1, 5))]
    batches = [pa.record_batch([pa.array(x, t) for x, t in zip(zip(*lines[a : a + 4]), (pa.int64(), pa.int32(), pa.string()))], ["chunk_id", "pos", "tokens"]) for a in range(0, len(lines), 4)]

    def counts():
        rows = [r for b in R.N.count_part(iter(batches), 0, 3, schema) for r in b.to_pylist()]
        terms = [t for r in sorted(rows, key=lambda r: r["bucket"]) if r["bucket"] >= 0 for t in r["body"].split("\n")]
        own, at, out = next(r for r in rows if r["bucket"] < 0), 0, {}
        steps, tf = R.N.unpacked(own["numbers"]), R.N.unpacked(own["tfs"])
        for chunk, size in zip(own["chunks"], R.N.unpacked(own["sizes"])):
            out[chunk] = {terms[i]: int(x) for i, x in zip(np.cumsum(steps[at : at + size]), tf[at : at + size])}
            at += size
        return out

    want, words = {}, []
    for chunk, i, line in lines:
        words = [*(words if i else []), *filter(None, line.split("\n"))]
        new = len(list(filter(None, line.split("\n"))))
        grams = words[len(words) - new :] + [f"{words[j - 1]} {words[j]}" for j in range(len(words) - new, len(words)) if j]
        want.setdefault(chunk, Counter()).update(grams)
    want = {c: dict(x) for c, x in want.items()}
    assert counts() == want
    monkeypatch.setattr(R.N, "FOLD_BYTES", 1)
    assert counts() == want


def test_no_row_is_written_for_an_ngram(spark, monkeypatch):
    n = 300  # with 300 n-grams and more each
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), (i * F.col("id") % 9973).cast("string"))), " ")
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), text.alias("text"))
    written = {}

    def keep(df, name):
        written[name] = stored(df, name)
        return written[name]

    monkeypatch.setattr(R, "stored", keep)
    R.tfidf_topk(chunks, spark.createDataFrame([(1, "w7 w14 w21")], "query_id long, query string")).collect()
    assert all(df.count() < n for df in written.values())


def test_outcome_stream_of_very_many_documents(spark, tmp_path):
    n = 40_000  # a call of Python for each would take minutes
    i = F.col("id")
    # the second file holds earlier ends of documents of the first one, which are too late to count
    rows = spark.range(3 * n).select(
        F.when(i % 97 > 0, i % n).alias("doc_id"), F.when(i % 89 > 0, F.timestamp_seconds(i * 7919 % 1000)).alias("ts"), F.when(i % 83 > 0, i).alias("line_no"),
        F.when(i % 79 > 0, i % 2).cast("int").alias("exit_code"), F.when(i % 73 > 0, i + 2**53).alias("num_chunks"), (i >= 2 * n).alias("later"),
    )
    for later in (False, True):
        rows.filter(F.col("later") == later).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = spark.range(0, n, 50).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("num_chunks"))
    start = time.monotonic()
    L.outcome_stream(ends, store, str(tmp_path / "out"), str(tmp_path / "cp"), 16)
    assert time.monotonic() - start < 60
    out = spark.read.schema(L.OUTCOME).parquet(str(tmp_path / "out")).toArrow().to_pylist()
    want = {}
    for r in rows.withColumn("us", F.unix_micros("ts")).toArrow().to_pylist():
        place = (r["later"], *((x is None, x or 0) for x in (r["us"], r["line_no"])))
        if r["doc_id"] not in want or place < want[r["doc_id"]][0]:
            want[r["doc_id"]] = place, r["exit_code"], r["num_chunks"]
    told = lambda d, code, c: ("already_exists", 3) if d is not None and d % 50 == 0 else ("success", c) if code == 0 else ("failed", 0)
    assert len(out) == len(want) and {r["doc_id"]: (r["status"], r["num_chunks"]) for r in out} == {d: told(d, code, c) for d, (_, code, c) in want.items()}
