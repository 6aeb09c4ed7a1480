"""Decisions per query: gate, tier, fallback, and the texts they lead to."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions import keywords as K
from statuta.functions import scores as S
from statuta.functions.citations import display_citation
from statuta.functions.keywords import VIETNAMESE, Lexicon
from statuta.functions.text import strip


def query_features(queries: DataFrame, ranked: DataFrame, lexicon: Lexicon = VIETNAMESE, first: int = 5) -> DataFrame:
    """One row per query with all that the decisions look at.

    ``ranked(query_id, rank, text, score_rerank, van_ban)`` holds the few chunks kept per
    query; its texts meet in one row, as the context they are.
    """
    row = F.struct("rank", "text", F.col("score_rerank").alias("score"), "van_ban")
    per_query = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    at = lambda i, field: F.try_element_at("c", F.lit(i))[field]
    out = queries.join(per_query, "query_id", "left").select(
        "query_id",
        "query",
        F.coalesce(F.size("c"), F.lit(0)).alias("n_chunks"),
        F.coalesce(at(1, "score"), F.lit(0.0)).alias("top1"),
        F.coalesce(at(2, "score"), F.lit(0.0)).alias("top2"),
        at(1, "text").alias("top_text"),
        at(1, "van_ban").alias("top_title"),
        F.coalesce(F.array_join(F.slice("c", 1, first)["text"], " "), F.lit("")).alias("context"),
        F.coalesce(F.array_join(F.col("c.text"), " "), F.lit("")).alias("all_text"),
        K.keywords(F.col("query"), lexicon).alias("kw"),
    )
    # scores are sums whose last digits depend on their order; equal ones shall have no margin
    margin = F.round(F.col("top1") - F.col("top2"), 9)
    out = out.withColumn("n_chunks", F.greatest("n_chunks", F.lit(0)).cast("long")).withColumn("margin", margin)
    return out.withColumns(
        {
            "overlap": K.overlap(F.col("kw"), F.col("context")),
            "cov": K.coverage(F.col("kw"), F.col("all_text")),
            "fallback_coverage": K.fallback_coverage(F.col("query"), F.col("context"), lexicon),
            "query_type": K.query_type(F.col("query"), lexicon),
            "context_tokens": F.floor(F.length("context") / F.lit(1.5)).cast("long"),
            "clarify": K.clarification(F.col("query"), lexicon),
            "missing_info": K.missing_info(F.col("query"), lexicon),
            "gate_question": K.gate_question(F.col("query"), K.coverage(F.col("kw"), F.col("all_text"))["missing"], lexicon),
            "generic_question": K.generic_question(F.col("query"), lexicon),
        }
    )


def profile(name: str, overrides: dict | None = None) -> Column:
    """A gate profile as a struct: the default thresholds with the given ones in their place."""
    values = {**V.GATE_DEFAULT, **(overrides or {})}
    return F.struct(F.lit(name).alias("profile"), *[F.lit(v).alias(k) for k, v in values.items()])


PRESETS = V.GATE_PRESETS


def tier(top: Column, margin: Column, p: Column) -> Column:
    effective = S.effective_margin(top, margin, p["score_is_sigmoid"])
    return (
        F.when((top >= p["tier_local_min_score"]) & (effective >= p["tier_local_min_margin"]), F.lit("local"))
        .when(top >= p["tier_api_min_score"], F.lit("api"))
        .otherwise(F.lit("none"))
    )


def tier_reason(tier_: Column, decision: Column, top: Column, margin: Column, p: Column) -> Column:
    s, m, low, least = (F.format_string("%.4f", c) for c in (top, margin, p["tier_local_min_margin"], p["tier_local_min_score"]))
    return (
        F.when(tier_ == "local", F.concat(F.lit("Score "), s, F.lit(" >= "), least, F.lit(", Margin "), m, F.lit(" >= "), low))
        .when((tier_ == "api") & (decision == "cautious"), F.lit("CAUTIOUS → route to API for better generation"))
        .when(tier_ == "api", F.concat(F.lit("Score "), s, F.lit(" or Margin "), m, F.lit(" low → API")))
        .otherwise(F.lit("Score thấp / Abstain → không gọi LLM"))
    )


def gate(features: DataFrame, profiles: list[Column]) -> DataFrame:
    """Features with one row per profile and its decision.

    Each rule is a test with an outcome; the first test that holds decides, and ``rule``
    names it. Profiles are a short literal list, so no join is needed.
    """
    p = F.col("p")
    top, margin = F.col("top1"), F.col("margin")
    effective = S.effective_margin(top, margin, p["score_is_sigmoid"])
    sure = p["score_is_sigmoid"] & (top >= p["threshold_pass"])
    asks = p["enable_ask_back"]
    thin = (top < p["threshold_pass"]) & (F.col("cov.coverage") < p["min_keyword_coverage"])
    clear_tier = tier(top, margin, p)
    none, null = F.lit("none"), F.lit(None).cast("string")

    def outcome(rule: str, decision: str, reason, tier_=none, question=null) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(decision).alias("decision"), (null if reason is None else F.lit(reason)).alias("reason"),
            tier_.alias("tier"), question.alias("clarification_question"),
        )

    api = F.lit("api")
    rules = [
        (F.col("n_chunks") == 0, outcome("no_chunks", "abstain", "no_relevant_chunk")),
        (top < p["threshold_abstain"], outcome("low_score", "abstain", "low_confidence")),
        (
            ~sure & (effective < p["margin_min"]) & asks & p["ask_back_on_ambiguous"],
            outcome("margin", "ask_back", "ambiguous_query", none, F.lit(V.AMBIGUOUS_QUESTION)),
        ),
        (thin & asks, outcome("coverage", "ask_back", "missing_legal_keyword", none, F.col("gate_question"))),
        (thin, outcome("coverage", "cautious", "missing_legal_keyword", api)),
        (F.col("overlap") < 0.05, outcome("no_overlap", "cautious", "missing_legal_keyword", api)),
        (
            (F.col("overlap") < p["min_lexical_overlap"]) & (top < p["tier_local_min_score"]),
            outcome("low_overlap", "cautious", "missing_legal_keyword", api),
        ),
        (F.col("clarify").isNotNull() & asks, outcome("unclear", "ask_back", "ambiguous_query", none, F.col("clarify"))),
        (top >= p["threshold_pass"], outcome("pass", "answer", None, clear_tier)),
        (top >= p["threshold_cautious"], outcome("cautious", "cautious", None, api)),
    ]
    decided = F.coalesce(*[F.when(test, result) for test, result in rules], outcome("below_pass", "abstain", "low_confidence"))
    out = features.withColumn("p", F.explode(F.array(*profiles))).withColumn("g", decided)
    with_chunks = F.col("n_chunks") > 0
    value = lambda c: F.when(with_chunks, c).otherwise(F.lit(0.0))
    return out.select(
        *features.columns, "p", F.col("p.profile").alias("profile"), "g.*", value(top).alias("confidence"),
        value(S.confidence(top, margin, p["margin_scale"], p["score_is_sigmoid"])).alias("confidence_final"),
        value(S.similarity(top, p["score_is_sigmoid"])).alias("semantic_similarity"), F.col("overlap").alias("lexical_overlap"),
    )


def quick_gate(top: Column, n_chunks: Column, threshold: float = 0.5) -> Column:
    """struct(passed, reason)."""
    reason = (
        F.when(n_chunks == 0, F.lit("No chunks available"))
        .when(top < threshold, F.lit("Top score below threshold"))
        .otherwise(F.lit("Passed quick gate"))
    )
    return F.struct(((n_chunks > 0) & (top >= threshold)).alias("passed"), reason.alias("reason"))


def gated_output(decisions: DataFrame) -> DataFrame:
    """Output rows of the queries that are settled without generation."""
    return decisions.filter(F.col("decision").isin("abstain", "ask_back")).select(
        "query_id", "profile", F.lit(None).cast("string").alias("answer"), "decision", F.lit(True).alias("abstain"),
        F.col("reason").alias("abstain_reason"), "clarification_question", F.col("confidence").alias("confidence_score"),
    )


def fallback(features: DataFrame) -> DataFrame:
    """Add (fallback_type, missing_type, fallback_question) by score, missing information and coverage."""
    top = F.col("top1")
    low = F.col("missing_info.kind").isNotNull()
    kind = (
        F.when(F.col("n_chunks") == 0, F.lit("abstain"))
        .when((top < 0.3) & low, F.lit("ask_back"))
        .when(top < 0.3, F.lit("abstain"))
        .when((top < 0.7) & (F.col("fallback_coverage") < 0.3), F.lit("ask_back"))
        .when(top < 0.7, F.lit("cautious"))
        .otherwise(F.lit("none"))
    )
    out = features.withColumn("fallback_type", kind)
    by_info = (F.col("fallback_type") == "ask_back") & (top < 0.3)
    return out.withColumns(
        {
            "missing_type": F.when(by_info, F.col("missing_info.kind")),
            "fallback_question": F.when(by_info, F.col("missing_info.question")).when(F.col("fallback_type") == "ask_back", F.col("generic_question")),
        }
    )


def fallback_render(decided: DataFrame) -> DataFrame:
    """Add (final_answer, final_decision, applied) to rows with ``fallback`` columns, ``answer`` and ``n_citations``."""
    given = F.coalesce(F.col("answer"), F.lit(""))
    full = strip(given) != ""
    text = F.coalesce(F.col("top_text"), F.lit(""))
    summary = F.concat(F.left(text, F.lit(200)), F.when(F.length(text) > 200, F.lit("...")).otherwise(""))
    partial = F.concat(
        F.lit(V.NEED_MORE + "\n\n" + V.FOUND_IN), F.coalesce(F.col("top_title"), F.lit("")), F.lit(':\n"...'), summary, F.lit('..."\n')
    )
    ask = F.concat(F.when(F.col("n_chunks") > 0, partial).otherwise(""), F.lit("\n\n❓ "), F.col("fallback_question"))
    warning = F.when(F.col("n_citations") > 0, F.lit(V.SHORT_WARNING)).otherwise(F.lit(V.CAUTIOUS_WARNING))
    cautious = F.when(full, F.concat(strip(given), F.lit("\n\n"), warning)).otherwise(F.lit(f"{V.CAUTIOUS_PREFIX}\n\n{V.CAUTIOUS_WARNING}"))
    abstain = F.lit(f"{V.NO_INFO}\n\n{V.RETRY_HINT}")
    kind = F.col("fallback_type")
    return decided.withColumns(
        {
            "final_answer": F.when(kind == "ask_back", ask).when(kind == "cautious", cautious).when(kind == "abstain", abstain).otherwise(F.col("answer")),
            "final_decision": F.when(kind == "none", F.lit("answer")).otherwise(kind),
            "applied": kind != "none",
        }
    )


def log_rows(decided: DataFrame, ranked: DataFrame, answers: DataFrame, context: DataFrame, settings: dict) -> DataFrame:
    """One log row of the fixed columns per decided query.

    ``decided`` comes from ``gate`` with one profile, ``ranked(query_id, rank, chunk_id, score_retrieval)``,
    ``answers(query_id, answer, citations, status, error, latencies...)``, ``context(query_id, n_chunks_kept)``.
    Everything is one row per query before it is joined.
    """
    first = ranked.filter("rank = 1").select("query_id", F.col("chunk_id").alias("top1_chunk_id"), F.col("score_retrieval").alias("score_retrieval_top1"))
    p = F.col("p")
    cites = F.transform("citations", lambda c: display_citation(c["van_ban"], c["dieu"], c["khoan"], c["diem"]))
    rows = decided.join(first, "query_id", "left").join(context, "query_id", "left").join(answers, "query_id", "left")
    text = F.coalesce(F.col("answer"), F.lit(""))
    fixed = {name: F.lit(value) for name, value in settings.items()}
    columns = {
        "threshold_pass": p["threshold_pass"], "tier_local_min_score": p["tier_local_min_score"],
        "tier_reason": tier_reason(F.col("tier"), F.col("decision"), F.col("top1"), F.col("margin"), p),
        "gating_decision": F.col("decision"), "gating_reason": F.col("rule"), "gating_confidence": F.col("confidence"),
        "context_token_length": F.col("context_tokens"), "score_rerank_top1": F.col("top1"), "score_rerank_top2": F.col("top2"),
        "num_chunks_retrieved": F.col("n_chunks"), "num_chunks_after_dedup": F.coalesce("n_chunks_kept", F.lit(0)),
        "top1_chunk_id": F.coalesce("top1_chunk_id", F.lit(-1)), "top1_text_preview": F.coalesce(F.left("top_text", F.lit(100)), F.lit("")),
        "score_retrieval_top1": F.coalesce("score_retrieval_top1", F.lit(0.0)),
        "generated_answer": F.left(text, F.lit(500)), "answer_length": F.length(text).cast("long"),
        "num_citations": F.coalesce(F.size("citations"), F.lit(0)).cast("long"), "citations_str": F.coalesce(F.array_join(cites, ", "), F.lit("")),
        **fixed,
    }
    return rows.withColumns(columns).select(*V.LOG_COLUMNS)
