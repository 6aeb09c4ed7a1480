"""Gold sets, hits, citation scores and comparisons of retrieval versions."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.matching import chunk_citation_match, citation_pairs, hit_join
from statuta.operators.reports import eval_summary

META = ["van_ban", "chuong", "dieu", "khoan", "diem"]


def _citation(missing: Column | None) -> Column:
    text = lambda c: F.coalesce(F.col(f"meta.{c}"), missing) if missing is not None else F.col(f"meta.{c}")
    return F.array(F.struct(*[text(c).alias(c) for c in META], F.coalesce(F.col("meta.chunk_index"), F.lit(-1)).cast("long").alias("chunk_index")))


def goldset_build(rows: DataFrame) -> DataFrame:
    """(id, query, expected_citations) from ``rows(pos, query, passage, label, meta)``; no label counts as positive."""
    kept = rows.filter(F.coalesce("label", F.lit(1)) == 1)
    number = F.col("pos").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return kept.select(F.concat(F.lit("eval_"), padded).alias("id"), "query", _citation(F.lit("")).alias("expected_citations"))


def goldset_dedup(rows: DataFrame) -> DataFrame:
    """First row per query, then only positives: a query first seen as negative is gone.

    The first row is found by aggregation, so a query repeated very often folds before the shuffle.
    """
    first = rows.groupBy("query").agg(F.min_by(F.struct("pos", "passage", "label", "meta"), "pos").alias("r")).select("query", "r.*")
    return first.filter("label = 1").select(
        F.concat(F.lit("dev_"), F.col("pos").cast("string")).alias("id"), "query", _citation(None).alias("expected_citations"),
        F.col("passage").alias("expected_answer"),
    )


def goldset_load(rows: DataFrame) -> DataFrame:
    """``rows(pos, id, query, question, expected_answer, is_answerable)`` with aliases and defaults resolved."""
    return rows.select(
        F.coalesce("id", F.concat(F.lit("q_"), F.col("pos").cast("string"))).alias("id"),
        F.coalesce("query", "question", F.lit("")).alias("query"), "expected_answer",
        F.coalesce("is_answerable", F.lit(True)).alias("is_answerable"),
    )


def per_query_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hit1, hit3, hit5, mrr) for every query; only the first five ranks count."""
    best = hits.filter("hit").groupBy("query_id").agg(F.min("rank").alias("best"))
    out = queries.select("query_id").join(best, "query_id", "left")
    at = lambda k: F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias(f"hit{k}")
    mrr = F.when(F.col("best") <= 5, F.round(1.0 / F.col("best"), 4)).otherwise(0.0)
    return out.select("query_id", at(1), at(3), at(5), mrr.alias("mrr"))


def recall_mrr(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean hits at one, three, five and mean reciprocal rank, to four places."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    names = {"hit1": "recall_at_1", "hit3": "recall_at_3", "hit5": "recall_at_5", "mrr": "mrr_at_5"}
    return per_query.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *[mean(c).alias(n) for c, n in names.items()])


def result_entries(queries: DataFrame, hits: DataFrame, per_query: DataFrame) -> DataFrame:
    """Nested record per query: hits, reciprocal rank and its first five results."""
    item = F.struct("rank", "hit", F.round("score", 4).alias("score"), *META, "chunk_index")
    top5 = hits.filter("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("top5_reranked"))
    return queries.join(per_query, "query_id").join(top5, "query_id", "left")


def citation_prf(queries: DataFrame, outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1, exact_match) of the citations of every query.

    Nothing expected is all right; nothing given where something is expected is all wrong.
    """
    pairs = citation_pairs(outputs, expected)
    matched = pairs.groupBy("query_id").agg(F.count_distinct("out_no").alias("m_out"), F.count_distinct("exp_no").alias("m_exp"))
    n_out = outputs.groupBy("query_id").agg(F.count("*").alias("n_out"))
    n_exp = expected.groupBy("query_id").agg(F.count("*").alias("n_exp"))
    counts = queries.select("query_id").join(n_out, "query_id", "left").join(n_exp, "query_id", "left").join(matched, "query_id", "left")
    counts = counts.fillna(0, ["n_out", "n_exp", "m_out", "m_exp"])
    p = F.coalesce(F.try_divide("m_out", "n_out"), F.lit(0.0))
    r = F.coalesce(F.try_divide("m_exp", "n_exp"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    free = F.col("n_exp") == 0
    rows = counts.withColumns({"p": p, "r": r}).withColumn("f1", f1)
    value = lambda c: F.when(free, F.lit(1.0)).otherwise(F.round(c, 4))
    exact = ((F.col("m_exp") == F.col("n_exp")) & (F.col("n_out") > 0)).cast("double")
    return rows.select(
        "query_id", value(F.col("p")).alias("precision"), value(F.col("r")).alias("recall"), value(F.col("f1")).alias("f1"),
        F.when(free, F.lit(1.0)).otherwise(exact).alias("exact_match"),
    )


def hit_with_fallback(outputs: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Add ``citation_hit`` to ``outputs(query_id, abstain, n_citations, recall)``: by citations, or by the
    first five chunks where there are none to judge."""
    top = chunk_citation_match(ranked.filter("rank <= 5"), expected)
    by_chunk = top.groupBy("query_id").agg(F.max("matched").alias("_chunk"))
    judged = ~F.col("abstain") & (F.col("n_citations") > 0)
    hit = F.when(judged, F.col("recall") > 0).otherwise(F.coalesce("_chunk", F.lit(False)))
    return outputs.join(by_chunk, "query_id", "left").withColumn("citation_hit", hit).drop("_chunk")


def compare_versions(runs: dict[str, DataFrame], queries: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics of several ranked runs side by side; each run is shaped like the input of ``hit_join``."""
    parts = [per_query_hits(queries, hit_join(run, expected)).withColumn("version", F.lit(v)) for v, run in runs.items()]
    return recall_mrr(reduce(DataFrame.unionByName, parts), ["version"])


def evaluate(gold: DataFrame, retriever: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(per-query rows, summary) of any retriever, a function from queries to ranked chunks with metadata."""
    ranked = retriever(gold.select("query_id", "query"))
    outputs = gold.select("query_id", F.lit(False).alias("abstain"), F.lit(0).alias("n_citations"), F.lit(0.0).alias("recall"))
    rows = hit_with_fallback(outputs, ranked, gold)
    zero = {c: F.lit(0.0) for c in ("citation_precision", "citation_recall", "citation_f1", "latency_llm_ms", "latency_total_ms")}
    rows = rows.withColumns({**zero, "gating_decision": F.lit("answer"), "error": F.lit("")})
    return rows, eval_summary(rows)
