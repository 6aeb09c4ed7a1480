"""Corpus audit, run and log statistics, calibration."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import collapsed_key, strip
from statuta.joins import BROADCAST_ROWS, within
from statuta.operators.ranges import numbered, prefix_sum


def corpus_audit(chunks: DataFrame, key_length: int = 500) -> DataFrame:
    """One row of counts and lengths; copies are all but the first of a 500-character key."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    n = F.length(text)
    # copies fold before they travel: one row per key and task
    keys = chunks.select(F.md5(collapsed_key(text, key_length)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    copies = keys.agg(F.sum(F.col("n") - 1)).scalar()
    return chunks.agg(
        F.count("*").alias("total"),
        F.count_if(n == 0).alias("empty_chunks"),
        F.count_if((n > 0) & (n < 50)).alias("short_chunks"),
        F.count_if(n > 3000).alias("long_chunks"),
        F.min(n).cast("long").alias("length_min"),
        F.max(n).cast("long").alias("length_max"),
        F.round(F.avg(n), 1).alias("length_avg"),
        F.count_if(F.col("empty_metadata")).alias("empty_metadata"),
    ).withColumn("duplicates", copies)


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing): rows where the field is null or empty."""
    counts = rows.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "missing")


def top_groups(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def count_consistency(vectors: DataFrame, chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    out = chunks.agg(F.count("*").alias("n_chunks"))
    out = out.withColumn("n_vectors", vectors.agg(F.count("*")).scalar()).withColumn("n_corpus", corpus.agg(F.count("*")).scalar())
    return out.withColumn("consistent", (F.col("n_chunks") == F.col("n_vectors")) & (F.col("n_chunks") == F.col("n_corpus")))


def _share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def eval_summary(results: DataFrame) -> DataFrame:
    """One row of rates and means; zeros without rows."""
    rate = lambda c, places=4: F.round(F.coalesce(c, F.lit(0.0)), places)
    return results.agg(
        F.count("*").alias("total_samples"),
        rate(_share(F.col("citation_hit"))).alias("citation_hit_rate"),
        *[rate(F.avg(f"citation_{m}")).alias(f"avg_citation_{m}") for m in ("precision", "recall", "f1")],
        *[
            rate(_share(F.coalesce(F.col("gating_decision"), F.lit("")) == d)).alias(f"{n}_rate")
            for d, n in (("answer", "pass"), ("abstain", "abstain"), ("ask_back", "ask_back"), ("cautious", "cautious"))
        ],
        *[rate(F.avg(f"latency_{m}_ms"), 2).alias(f"avg_latency_{m}_ms") for m in ("llm", "total")],
        rate(_share(F.coalesce(F.col("error"), F.lit("")) != "")).alias("error_rate"),
    )


def run_summary(outputs: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of tier counts and rates. Citation hits are counted per citation, so their rate
    may exceed one; ``query_hit_rate`` counts queries.

    ``outputs(query_id, tier, decision, abstain, is_error)``, ``matched(query_id, out_no)``.
    """
    hits = matched.join(outputs.filter("NOT abstain").select("query_id"), "query_id").select("query_id", "out_no").distinct()
    per_query = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = outputs.join(per_query, "query_id", "left").fillna(0, ["hits"])
    n = F.count("*")
    tier = lambda t: F.count_if(F.col("tier") == t)
    rate = lambda c: F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 4)
    return rows.agg(
        n.alias("total"), tier("local").alias("n_local"), tier("api").alias("n_api"), tier("none").alias("n_none"),
        rate(F.sum("hits")).alias("citation_hit_rate"), rate(F.count_if(F.col("hits") > 0)).alias("query_hit_rate"),
        rate(F.count_if(F.col("decision").isin("answer", "cautious"))).alias("pass_rate"), rate(F.count_if("is_error")).alias("error_rate"),
        F.round(F.coalesce(F.try_divide((tier("local") + tier("none")) * 100, n), F.lit(0.0)), 1).alias("savings_percent"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    """(part, name, n, rate, value): per tier, per decision, and the overall figures, in long form."""
    total = log.agg(F.count("*")).scalar()
    counted = lambda part, column: log.groupBy(F.lit(part).alias("part"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    groups = counted("tier", "tier").unionByName(counted("decision", "gating_decision")).withColumn("rate", F.round(F.col("n") / total, 4))
    overall = log.agg(
        F.count("*").alias("n"),
        F.round(F.avg("latency_total_ms"), 1).alias("avg_latency_total_ms"),
        F.round(_share(F.coalesce(F.col("error"), F.lit("")) != ""), 4).alias("error_rate"),
        F.round(_share(F.col("tier").isin("local", "none")), 4).alias("api_savings_rate"),
    )
    names = ["avg_latency_total_ms", "error_rate", "api_savings_rate"]
    long = overall.unpivot(["n"], names, "name", "value").withColumn("part", F.lit("overall")).withColumn("rate", F.lit(None).cast("double"))
    return groups.withColumn("value", F.lit(None).cast("double")).unionByName(long)


def latency_stats(log: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(stage, mean, min, max) over the values above zero."""
    long = log.select(*[F.col(c).cast("double").alias(label) for label, c in stages.items()]).unpivot([], list(stages), "stage", "ms")
    return long.filter("ms > 0").groupBy("stage").agg(
        F.round(F.avg("ms"), 1).alias("mean_ms"), F.round(F.min("ms"), 1).alias("min_ms"), F.round(F.max("ms"), 1).alias("max_ms")
    )


def tier_breakdown(log: DataFrame) -> DataFrame:
    """One row per tier, also without log rows: count, share, means, errors, and the cost figures."""
    spark = log.sparkSession
    tiers = spark.createDataFrame([("local",), ("api",), ("none",)], "tier string")
    stats = log.groupBy("tier").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score_rerank_top1"), 2).alias("avg_score"),
        F.round(F.avg("margin"), 2).alias("avg_margin"),
        F.round(F.avg("latency_total_ms"), 1).alias("avg_latency_ms"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    )
    total = log.agg(F.count("*").alias("total"), F.count_if(F.col("tier").isin("local", "none")).alias("saved")).select(F.struct("*")).scalar()
    out = tiers.join(stats, "tier", "left").fillna(0, ["n", "errors"]).withColumn("t", total)
    return out.select(
        "tier", "n", F.round(F.coalesce(F.try_divide("n", F.col("t.total")), F.lit(0.0)), 3).alias("share"), "avg_score", "avg_margin", "avg_latency_ms", "errors",
        F.round(F.coalesce(F.try_divide(F.col("t.saved") * 100, F.col("t.total")), F.lit(0.0)), 1).alias("savings_percent"),
    )


def gating_quality(decisions: DataFrame) -> DataFrame:
    """One row from ``decisions(decision, answerable)``; zero where nothing was counted."""
    passed, ok = F.col("decision").isin("answer", "cautious"), F.col("answerable")
    tp, tn = F.count_if(passed & ok), F.count_if(~passed & ~ok)
    fp, fn = F.count_if(passed & ~ok), F.count_if(~passed & ok)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    n = F.count("*")
    return decisions.agg(
        rate(tp, tp + fp).alias("pass_precision"), rate(tn, tn + fn).alias("abstain_precision"),
        rate(F.count_if(F.col("decision").isin("abstain", "ask_back")), n).alias("abstain_rate"),
        rate(fp, n).alias("false_positive_rate"), rate(tp, n).alias("true_positive_rate"),
    )


PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def score_percentiles(scores: DataFrame, least: int = 100) -> DataFrame:
    """One row of exact order statistics and the thresholds they set; nothing below ``least`` scores.

    Scores are counted per value and the counts summed up in order, so the whole history is
    never sorted in one task. The value at index i is the one whose run of copies covers i.
    """
    runs = prefix_sum(scores.groupBy("score").agg(F.count("*").alias("n")), "score", "n", "before")
    total = scores.agg(F.count("*")).scalar()
    runs = runs.withColumn("total", total).filter(F.col("total") >= least)
    at = lambda p: F.floor(F.col("total") * F.lit(p))
    pick = lambda p: F.max(F.when((F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("n")), F.col("score")))
    out = runs.groupBy("total").agg(*[pick(p).alias(name) for name, p in PERCENTILES.items()])
    return out.withColumns({"threshold_pass": F.col("p75"), "threshold_cautious": F.col("p50"), "threshold_abstain": F.col("p10")})


def percentile_rank(rows: DataFrame, score: str) -> DataFrame:
    """Add ``percentile``: the share of scores strictly below."""
    counts = rows.groupBy(score).agg(F.count("*").alias("n"))
    below = prefix_sum(counts, score, "n", "below").select(score, "below")
    # where the values are many, so are the tasks that they are dealt to, and adaptive execution splits a common one
    out = rows.join(F.broadcast(below) if within(below, BROADCAST_ROWS) else below, score)
    return out.withColumn("percentile", F.col("below") / rows.agg(F.count("*")).scalar()).drop("below")


def top_margin(ranked: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, top1, top2, margin); the second score is zero when there is none."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    out = ranked.filter("rank <= 2").groupBy("query_id").agg(at(1).alias("top1"), F.coalesce(at(2), F.lit(0.0)).alias("top2"))
    return out.withColumn("margin", F.col("top1") - F.col("top2"))


def ablation_lift(versions: DataFrame, metrics: list[str]) -> DataFrame:
    """(step, metric, value, vs_first_pp, step_pp, relative) of ``versions(step, metrics...)``; one row per version."""
    long = versions.unpivot(["step"], metrics, "metric", "value")
    order = W.partitionBy("metric").orderBy("step")
    first, before = F.first("value").over(order), F.lag("value").over(order)
    return long.select(
        "step", "metric", "value", F.round((F.col("value") - first) * 100, 2).alias("vs_first_pp"),
        F.round((F.col("value") - before) * 100, 2).alias("step_pp"), F.round(F.try_divide(F.col("value"), first) - 1, 4).alias("relative"),
    )


def first_occurrence(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of the parts, one per ``key``: from the earliest part, in its order.

    Folded as an aggregation, so copies of one passage shrink before the shuffle.
    """
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged).filter(F.coalesce(F.col(key), F.lit("")) != "")
    others = [c for c in parts[0].columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others, "_part"), F.struct("_part", order)).alias("r"))
    return first.select(key, "r.*")


def trailing_count(requests: DataFrame, seconds: int = 60, block: int = 3600) -> DataFrame:
    """Add ``trailing``: requests of the same client in the last ``seconds``, this one included.

    Time is cut into blocks, so even a client with most of the traffic is spread; a request is
    also shown to every later block that its window reaches, where it only counts.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = seconds * 1_000_000
    home = F.floor(us / F.lit(block * 1_000_000)).cast("long")
    near_end = F.floor((us + span) / F.lit(block * 1_000_000)).cast("long")
    spread = requests.withColumn("_us", us).withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, near_end)))
    over = W.partitionBy("client", "_block").orderBy("_us").rangeBetween(-(span - 1), 0)
    return spread.withColumn("trailing", F.count("*").over(over)).filter("_block = _home").drop("_us", "_home", "_block")
