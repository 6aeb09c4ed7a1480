"""Retrieval over a table of queries: keyword, n-gram and vector search, and their fusion.

Tables: ``chunks(chunk_id, text, ...)``, ``queries(query_id, query)``,
``vectors(chunk_id, embedding)``, ``query_vectors(query_id, embedding)``.
Ranked results are ``(query_id, chunk_id, score, rank)``; ranks start at one, scores
are compared at nine places and ties go to the smaller chunk.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from statuta.functions import fixed_values as V
from statuta.functions.text import naming, tokens, words
from statuta.joins import sized_join, within
from statuta.operators import ngrams as N
from statuta.session import stored
from statuta.unfold import unfold

K1, B = 1.5, 0.75
QUERY_MATRIX_ROWS = 4096
VECTOR_CELL_ROWS = 20_000
#: Scores of queries and vectors that a task computes at once, about.
BLOCK_SCORES = 500_000


def top_ranked(scored: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """Dense ranks per query; with ``k`` each task keeps its own best ``k`` before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.round(score, 9).desc(), F.col("chunk_id"))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


# ---- keyword search ---------------------------------------------------------


def postings(chunks: DataFrame, pattern: str = V.VI_TOKEN_RUNS) -> DataFrame:
    """(chunk_id, dl, term, tf): term frequencies; texts are shuffled by chunk before they are cut, not all their terms."""
    dealt = chunks.select("chunk_id", "text").repartition("chunk_id")
    split = dealt.select("chunk_id", tokens(F.col("text"), pattern).alias("toks"))
    return (
        unfold(split, ["chunk_id", F.size("toks").cast("long").alias("dl")], "toks", "term")
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def query_terms(queries: DataFrame, pattern: str = V.VI_TOKEN_RUNS) -> DataFrame:
    return (
        unfold(queries, ["query_id"], tokens(F.col("query"), pattern), "term")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def corpus_size(chunks: DataFrame, pattern: str = V.VI_TOKEN_RUNS) -> Column:
    """struct(n, avgdl) as a scalar subquery."""
    lengths = chunks.select(F.size(tokens(F.col("text"), pattern)).alias("dl"))
    return lengths.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))).scalar()


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences per term."""
    return postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with the query.

    Only postings of query terms are shuffled. Repeated query terms count each time.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("toks"))
    exploded = unfold(split, ["chunk_id", F.size("toks").cast("long").alias("dl")], "toks", "term")
    hits = (
        sized_join(exploded, wanted, ["term"], ["chunk_id"], measure=terms)
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    # tf is read here too, so that both readers of ``hits`` share one exchange
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighted = (
        terms.join(df, "term")
        .withColumn("s", corpus_size(chunks))
        .select(
            "query_id",
            "term",
            (F.col("qtf") * F.log(1 + (F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"),
            F.col("s.avgdl").alias("avgdl"),
        )
    )
    tf = F.col("tf")
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return (
        sized_join(hits, weighted, ["term"], ["chunk_id"], measure=terms)
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(part).alias("score"))
    )


#: Rows (query, term) that one pass over the chunks scores at most, about.
PASS_TERMS = 100_000
#: Rows whose terms are looked up together, and pairs of a row and a query term that are scored together, about: what a task holds in
#: memory depends on these, not on how many rows a batch has.
SLICE_ROWS = 256
PASS_PAIRS = 250_000
#: Scores that wait in a task before they are ranked with those it holds, at least.
WAITING = 200_000


def _slices(batches):
    """The batches in parts of ``SLICE_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _found_terms(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, term number, tf) of the wanted terms in each row, and every row's token count (-1: none)."""
    tokens_ = batch.column("toks")
    flat, lengths = tokens_.flatten(), pc.fill_null(pc.list_value_length(tokens_), -1).to_numpy(zero_copy_only=False)
    number = pc.index_in(flat, value_set=terms)
    at = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(batch.num_rows), np.maximum(lengths, 0))[at]
    key, tf = np.unique(row.astype(np.int64) * len(terms) + number.take(pa.array(at)).to_numpy(), return_counts=True)
    return key // len(terms), key % len(terms), tf, lengths


class _Held:
    """The best ``k`` of each query that a task has seen, in the order of ``top_ranked``."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.waiting, self.n_waiting = k, None, [], 0
        self.least = np.full(queries, -np.inf)  # the k-th score of each query so far

    def add(self, q: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        near = np.round(score, 9) >= self.least[q]
        self.waiting.append((q[near], chunk[near], score[near]))
        self.n_waiting += int(near.sum())
        if self.n_waiting > max(WAITING, len(self.held[0]) if self.held else 0):
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        all_ = [*([self.held] if self.held else []), *self.waiting]
        if not all_:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, chunk, score = (np.concatenate(x) for x in zip(*all_))
        place = np.lexsort((chunk, -np.round(score, 9), q))
        q, chunk, score = q[place], chunk[place], score[place]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.held, self.waiting, self.n_waiting = (q[keep], chunk[keep], score[keep]), [], 0
        q, at, n = np.unique(self.held[0], return_index=True, return_counts=True)
        full = n == self.k
        self.least[q[full]] = np.round(self.held[2][at[full] + self.k - 1], 9)
        return self.held


def _bm25_pass(rows: DataFrame, wanted: pd.DataFrame, kinds: tuple[str, str], k: int, k1: float, b_: float) -> DataFrame:
    """Best ``k`` chunks of each task for the queries of ``wanted(query_id, term, qtf)``: a chunk is scored where its text is."""
    names = sorted(set(wanted["term"]))
    terms = pa.array(names, pa.string())
    ids, query = np.unique(wanted["query_id"], return_inverse=True)
    term = np.searchsorted(np.array(names, object), wanted["term"].to_numpy(object))

    def statistics(batches):
        df, n, counted, total = np.zeros(len(terms), np.int64), 0, 0, 0
        for part in _slices(batches):
            _, found, _, lengths = _found_terms(part, terms)
            df += np.bincount(found, minlength=len(terms))
            n, counted, total = n + part.num_rows, counted + int((lengths >= 0).sum()), total + int(lengths[lengths >= 0].sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([at, [-1, -2, -3]]), pa.int64()), pa.array(np.concatenate([df[at], [n, counted, total]]), pa.int64())], ["number", "n"])

    found = rows.select("toks").mapInArrow(statistics, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(found["number"].to_pylist(), found["n"].to_pylist()))
    df = np.array([sums.get(i, 0) for i in range(len(terms))], float)
    n, average = sums.get(-1, 0), sums.get(-3, 0) / max(1, sums.get(-2, 0))
    weight = wanted["qtf"].to_numpy() * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
    order = np.argsort(term, kind="stable")
    query, weight = query[order], weight[order]
    starts = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def scored(batches):
        held = _Held(len(ids), k)
        for part in _slices(batches):
            rows_, numbers, tfs, lengths = _found_terms(part, terms)
            sizes = starts[numbers + 1] - starts[numbers]
            ends, a = np.cumsum(sizes), 0
            while a < len(rows_):  # whole rows, of about so many pairs of row and query term
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PASS_PAIRS, "right")))
                b = int(np.searchsorted(rows_, rows_[b - 1], "right"))
                row, number, tf, size = rows_[a:b], numbers[a:b], tfs[a:b], sizes[a:b]
                a = b
                share = tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * lengths[row] / average))
                pair = np.repeat(np.arange(len(row)), size)
                own = np.repeat(starts[number], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
                key, inverse = np.unique(row[pair] * len(ids) + query[own], return_inverse=True)
                score = np.bincount(inverse, weight[own] * share[pair], len(key))
                held.add(key % len(ids), part.column("chunk_id").to_numpy()[key // len(ids)], score)
        q, chunk, score = held.best()
        yield pa.record_batch([pa.array(ids[q]), pa.array(chunk), pa.array(score)], ["query_id", "chunk_id", "score"])

    return rows.mapInArrow(scored, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 150, k1: float = K1, b: float = B) -> DataFrame:
    """The best ``k`` of ``bm25_scores``. Chunks are scored in the rows that hold them, and only each task's best are shuffled.

    Many queries are taken in passes of about ``PASS_TERMS`` query terms.
    """
    terms = query_terms(queries)
    passes = max(1, -(-terms.count() // PASS_TERMS))
    rows = chunks.select("chunk_id", tokens(F.col("text")).alias("toks"))
    kinds = tuple(d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (chunks, "chunk_id")))
    out = None
    for i in range(passes):
        wanted = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toPandas()
        part = _bm25_pass(rows, wanted, kinds, k, k1, b)
        out = part if out is None else out.unionByName(part)
    return top_ranked(out, k)


# ---- n-gram search ----------------------------------------------------------


NGRAM_TOKEN = r"[\p{L}\p{N}_]{2,}"


def ngrams(text: Column) -> Column:
    """Single tokens of two characters and more, then their neighbouring pairs."""
    found = F.regexp_extract_all(F.lower(text), F.lit(NGRAM_TOKEN), F.lit(0))

    def with_pairs(toks: Column) -> Column:
        fewer = F.greatest(F.size(toks) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(toks, 1, fewer), F.slice(toks, 2, fewer), lambda x, y: F.concat_ws(" ", x, y))
        return F.concat(toks, pairs)

    return naming(found, with_pairs)


#: A part of the chunks that one task counts has about so many characters, a bucket the terms of so many; few of them have at least so many.
PART_CHARACTERS, BUCKET_CHARACTERS = 4_000_000, 12_000_000
LEAST_CHARACTERS = 500_000


def _tfidf_hits(chunks: DataFrame, queries: DataFrame, min_df: int, max_df: float) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, ids, weights): the terms of queries that a chunk holds, and (query_id, id, qw): those of a query; both of unit length.

    Texts are dealt to parts by chunk, so that it is texts that are shuffled and not all their n-grams. A part counts its n-grams and
    writes numbers; of the terms themselves it sends each distinct one to a bucket, once, and the buckets give document frequencies
    back. So the norm of a chunk is summed where its counts are, and no row is made for an n-gram.
    """
    spark, kind = chunks.sparkSession, chunks.schema["chunk_id"].dataType
    counted = chunks.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("c")).first()
    n, characters, usual = counted["n"], counted["c"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = min(usual, -(-characters // LEAST_CHARACTERS))
    parts, buckets = (max(2, -(-characters // size), few) for size in (PART_CHARACTERS, BUCKET_CHARACTERS))
    # rows without a chunk are one document, as others of one id are, but may be many: they are dealt by text, and meet in the buckets
    dealt = chunks.select("chunk_id", "text").repartition(parts, "chunk_id", F.when(F.col("chunk_id").isNull(), F.xxhash64("text")))
    # no token goes on over the end of a line, and a line is less than a text to hold
    lines = unfold(dealt, ["chunk_id"], F.split(F.lower("text"), "\n"), "line", "pos")
    rows = lines.select("chunk_id", "pos", F.array_join(F.regexp_extract_all("line", F.lit(NGRAM_TOKEN), F.lit(0)), "\n").alias("tokens"))
    counts, hits_ = N.COUNTS.format(kind.simpleString()), N.HITS.format(kind.simpleString())
    counts_arrow, vocabulary_arrow, hits_arrow = (
        to_arrow_schema(StructType.fromDDL(x)) for x in (counts, N.VOCABULARY, hits_)
    )
    count = lambda batches: N.count_part(batches, TaskContext.get().partitionId(), buckets, counts_arrow)
    ngrams_ = stored(rows.mapInArrow(count, counts), "ngrams")
    q_counted = (
        unfold(queries, ["query_id"], ngrams(F.col("query")), "term")
        .filter(F.col("query_id").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    asked = q_counted.select("term").distinct().mapInArrow(lambda batches: N.ask(batches, buckets, counts_arrow), counts)
    terms = ngrams_.filter(F.col("bucket") >= 0).unionByName(asked).select("part", "bucket", "body", "counts")
    vocabulary = stored(
        terms.groupBy("bucket").applyInArrow(lambda t: N.bucket_vocabulary(t, min_df, max_df * n, vocabulary_arrow), N.VOCABULARY), "vocabulary"
    )
    known = vocabulary.filter(F.col("part") < 0).mapInArrow(lambda batches: N.asked_terms(batches, n), "term string, id long, idf double")
    q_weighted = q_counted.join(known, "term").select("query_id", "id", ((1 + F.log("tf")) * F.col("idf")).alias("qw"))
    q_norm = q_weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    q_unit = q_weighted.join(q_norm, "query_id").select("query_id", "id", (F.col("qw") / F.col("q_norm")).alias("qw"))
    own = ngrams_.filter(F.col("bucket") < 0).select("part", "bucket", "chunks", F.col("sizes").alias("one"), F.col("numbers").alias("two"), F.col("tfs").alias("three"))
    answers = vocabulary.filter(F.col("part") >= 0).select(
        "part", "bucket", F.lit(None).cast(own.schema["chunks"].dataType).alias("chunks"), F.col("dfs").alias("one"), F.col("places").alias("two"), F.col("asked").alias("three")
    )
    hits = own.unionByName(answers).groupBy("part").applyInArrow(lambda t: N.part_hits(t, n, hits_arrow), hits_)
    return hits, q_unit


#: Cells of queries and chunks that are scored at once, at most, or one row of them.
PASS_CELLS = 1_000_000


def _tfidf_pass(hits: DataFrame, wanted: pd.DataFrame, kinds: tuple[str, str], k: int | None) -> DataFrame:
    """(query_id, chunk_id, score) for the queries of ``wanted(query_id, id, qw)``; with ``k`` the best of each task."""
    ids, query = np.unique(wanted["query_id"], return_inverse=True)
    names, term = np.unique(wanted["id"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(term, kind="stable")
    query, weight = query[order], wanted["qw"].to_numpy()[order]
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))

    def given(q, chunk, score):
        return pa.record_batch([pa.array(ids[q]), pa.array(chunk), pa.array(score)], ["query_id", "chunk_id", "score"])

    def scored(batches):
        held = None if k is None else _Held(len(ids), k)
        for batch in batches:
            if not len(names):
                continue
            lists, chunk = batch.column("ids"), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            found, share = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            number = np.minimum(np.searchsorted(names, found), len(names) - 1)
            at = np.flatnonzero(names[number] == found)
            row, number, share = row[at], number[at], share[at]
            sizes = starts[number + 1] - starts[number]
            ends, a = np.cumsum(sizes), 0
            while a < len(row):  # whole rows, of about so many pairs of row and query term
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PASS_PAIRS, "right")))
                last = min(row[b - 1], row[a] + max(1, PASS_CELLS // len(ids)) - 1)
                b = int(np.searchsorted(row, last, "right"))
                size, base = sizes[a:b], row[a]
                own = np.repeat(starts[number[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                cells = np.bincount(np.repeat((row[a:b] - base) * len(ids), size) + query[own], weight[own] * np.repeat(share[a:b], size))
                cell = np.flatnonzero(cells > 0)  # all weights are
                q, c, score = cell % len(ids), chunk[base + cell // len(ids)], cells[cell]
                if held is None:
                    yield given(q, c, score)
                else:
                    held.add(q, c, score)
                a = b
        if held is not None and len(held.best()[0]):
            yield given(*held.best())

    return hits.mapInArrow(scored, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def tfidf_scores(chunks: DataFrame, queries: DataFrame, min_df: int = 2, max_df: float = 0.9, k: int | None = None) -> DataFrame:
    """Cosine of 1+ln(tf) weighted, idf scaled, unit-length n-gram vectors; with ``k`` only the best of each task.

    Many queries are taken in passes of about ``PASS_TERMS`` query terms.
    """
    hits, terms = _tfidf_hits(chunks, queries, min_df, max_df)
    passes = max(1, -(-terms.count() // PASS_TERMS))
    hits = stored(hits, "hits") if passes > 1 else hits
    kinds = tuple(d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (chunks, "chunk_id")))
    of = lambda i: terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toPandas()
    return reduce(DataFrame.unionByName, [_tfidf_pass(hits, of(i), kinds, k) for i in range(passes)])


def tfidf_topk(chunks: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_ranked(tfidf_scores(chunks, queries, k=k, **options), k)


# ---- vector search ----------------------------------------------------------


def _best(query_ids: np.ndarray, queries: np.ndarray, batches, k: int, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> pd.DataFrame:
    """The ``k`` best chunks per query over the batches, ties to the smaller chunk; none that comes after a query's bound (score, chunk)."""
    ids = [np.empty(0, np.int64)] * len(query_ids)
    scores = [np.empty(0)] * len(query_ids)
    least, last = bounds if bounds else (np.full(len(query_ids), -np.inf), np.zeros(len(query_ids), np.int64))
    least, last = least.copy(), last.copy()
    rows = max(1, BLOCK_SCORES // max(1, len(query_ids)))
    for pdf in (part.iloc[at : at + rows] for part in batches for at in range(0, len(part), rows)):
        block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        block_ids = pdf["chunk_id"].to_numpy()
        product = np.round(queries @ block.T, 9)
        # most queries gain nothing from most blocks once their bound is known
        for i in np.flatnonzero(np.fmax.reduce(product, axis=1) >= least):
            row = product[i]
            near = np.flatnonzero(row >= least[i])
            if len(near) > k:
                near = near[row[near] >= np.partition(row[near], -k)[-k]]
            if np.isfinite(least[i]):
                near = near[(row[near] > least[i]) | (block_ids[near] <= last[i])]
            all_ids = np.concatenate([ids[i], block_ids[near]])
            all_scores = np.concatenate([scores[i], row[near]])
            keep = np.lexsort((all_ids, -all_scores))[:k]
            ids[i], scores[i] = all_ids[keep], all_scores[keep]
            if len(keep) == k and (scores[i][-1], -ids[i][-1]) > (least[i], -last[i]):
                least[i], last[i] = scores[i][-1], ids[i][-1]
    sizes = [len(x) for x in ids]
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, sizes),
            "chunk_id": np.concatenate(ids) if ids else [],
            "score": np.concatenate(scores) if scores else [],
        }
    )


_BEST_SCHEMA = "query_id long, chunk_id long, score double"
#: One of so many vectors is scored first, for bounds; a table of fewer tasks than that is scored at once.
SLICES = 16
_SLICE_TASKS = 8


def _bounds(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    if "least" not in pdf:
        return None
    return pdf["least"].fillna(-np.inf).to_numpy(float), pdf["last"].fillna(0).to_numpy(np.int64)


def dense_partial(vectors: DataFrame, query_vectors: DataFrame, k: int, matrix_rows: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of each task's best ``k``, and with columns (least, last) of the queries only those up to that bound.

    A query matrix counted within ``matrix_rows`` travels to every vector task. A larger one is cut into blocks that meet cells of
    the vector table in a grid of bounded groups, so neither side has to fit anywhere whole.
    """
    matrix_rows = QUERY_MATRIX_ROWS if matrix_rows is None else matrix_rows
    if within(query_vectors, matrix_rows):
        local = query_vectors.toPandas()
        if local.empty:
            return vectors.sparkSession.createDataFrame([], _BEST_SCHEMA)
        matrix = np.stack(local["embedding"].to_numpy()).astype(np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy(), matrix, _bounds(local)))

        def scan(batches):
            names, values, bounds = shared.value
            yield _best(names, values, batches, k, bounds)

        return vectors.mapInPandas(scan, _BEST_SCHEMA)
    blocks = -(-query_vectors.count() // max(1, matrix_rows // 2))
    cells = -(-max(1, vectors.count()) // VECTOR_CELL_ROWS)
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = query_vectors.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("c", seq(cells))
    right = vectors.withColumn("c", F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int")).withColumn("b", seq(blocks))

    def cell(queries_pdf: pd.DataFrame, vectors_pdf: pd.DataFrame) -> pd.DataFrame:
        if queries_pdf.empty or vectors_pdf.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        values = np.stack(queries_pdf["embedding"].to_numpy()).astype(np.float64)
        return _best(queries_pdf["query_id"].to_numpy(), values, [vectors_pdf], k, _bounds(queries_pdf))

    return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(cell, _BEST_SCHEMA)


def dense_topk(vectors: DataFrame, query_vectors: DataFrame, k: int = 150, slices: int = SLICES, matrix_rows: int | None = None) -> DataFrame:
    """Exact inner-product top-k: block products in tasks, each keeping its own best ``k``.

    Over many tasks that would be k rows a query and task. So one vector of ``slices``, by hash, is scored first, in a few tasks; the
    k-th best of each query there is a bound that all others must meet, and what is shuffled is about ``slices`` times k rows a query.
    """
    vectors = vectors.select("chunk_id", "embedding")
    query_vectors = query_vectors.select("query_id", "embedding")
    if vectors.rdd.getNumPartitions() > slices:
        few = vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(slices)) == 0).repartition(_SLICE_TASKS)
        first = top_ranked(dense_partial(few, query_vectors, k, matrix_rows), k).filter(F.col("rank") == k)
        bounds = stored(first.select("query_id", F.col("score").alias("least"), F.col("chunk_id").alias("last")), "bounds")
        query_vectors = query_vectors.join(bounds, "query_id", "left")
    return top_ranked(dense_partial(vectors, query_vectors, k, matrix_rows), k)


# ---- fusion -----------------------------------------------------------------


def rrf_merge(lists: list[DataFrame], k: int = V.RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): sum of 1/(k+rank) over the ranked lists."""
    both = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank") for x in lists])
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return top_ranked(fused)


def dense_only_fallback(keyword: DataFrame, dense: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """Fusion where a query has keyword results, else 1/(k+rank) of its dense list.

    A dense list alone sums to just that, so one aggregation serves both.
    """
    return rrf_merge([keyword, dense], k)


def query_dedup(queries: DataFrame, key: Column, search) -> DataFrame:
    """Run ``search`` once per distinct key and give the result to every asker.

    ``search`` maps (query_id, query) to rows with query_id; the smallest query of a key asks.
    """
    keyed = queries.withColumn("_key", key)
    asked = keyed.groupBy("_key").agg(F.min("query_id").alias("_asker"), F.min_by("query", "query_id").alias("query"))
    found = search(asked.select(F.col("_asker").alias("query_id"), "query"))
    askers = keyed.select("query_id", "_key").join(asked.select("_key", "_asker"), "_key")
    return (
        found.withColumnRenamed("query_id", "_asker")
        .join(askers.select("query_id", "_asker"), "_asker")
        .drop("_asker")
    )


# ---- mining -----------------------------------------------------------------


def similar(candidate: Column, positive: Column, threshold: float = 0.9) -> Column:
    """Share of the positive's words found in the candidate is above the threshold."""
    p = F.array_distinct(words(F.lower(positive)))
    c = F.array_distinct(words(F.lower(candidate)))
    n = F.size(p)
    return F.when(n == 0, F.lit(False)).otherwise(F.size(F.array_intersect(p, c)) / n > threshold)


def hard_negatives(
    positives: DataFrame, neighbours: DataFrame, chunks: DataFrame, per_query: int = 2, skip: int = 10
) -> DataFrame:
    """(query_id, passage, label, pick): each positive and its first dissimilar neighbours after ``skip``."""
    pairs = (
        neighbours.filter(F.col("rank") > skip)
        .join(positives.select("query_id", "passage"), "query_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
        .filter(~similar(F.col("text"), F.col("passage")))
    )
    picked = pairs.withColumn("pick", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(
        F.col("pick") <= per_query
    )
    negative = picked.select("query_id", F.col("chunk_id"), F.col("text").alias("passage"), F.lit(0).alias("label"), "pick")
    positive = positives.select("query_id", F.lit(None).cast("long").alias("chunk_id"), "passage", F.lit(1).alias("label"), F.lit(0).alias("pick"))
    return positive.unionByName(negative)


def mining_counts(mined: DataFrame) -> DataFrame:
    """One row: positives, negatives, and positives for which no negative was found."""
    per_query = mined.groupBy("query_id").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )
    return per_query.agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.count_if(F.col("n") == 0).alias("n_without")
    )
