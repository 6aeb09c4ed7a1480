"""Topic and entity boosts, forced candidates, rerank decisions and the whole hybrid search."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.keywords import strings, word_runs
from statuta.functions.text import all_of, any_of, naming, tokens
from statuta.operators import retrieval as R
from statuta.joins import lookup, maybe_listed, sized_join
from statuta.session import stored


@dataclass(frozen=True)
class Topic:
    """Phrases worth something once a query triggers the topic (one mark of every trigger group)."""

    name: str
    triggers: list
    phrases: list
    must: list = field(default_factory=list)

    def asked(self, query_lower: Column) -> Column:
        return reduce(lambda a, b: a & b, [any_of(query_lower, group) for group in self.triggers])

    def amount(self, text_lower: Column) -> Column:
        parts = [F.when(F.contains(text_lower, F.lit(p)), F.lit(a)).otherwise(0.0) for p, a in self.phrases]
        return reduce(lambda a, b: a + b, parts)


@dataclass(frozen=True)
class Boosts:
    """Everything the boosts know; the defaults are the Vietnamese legal ones."""

    topics: tuple = (
        Topic("transfer", V.TRANSFER_TRIGGERS, V.TRANSFER_PHRASES, [p for p, _ in V.TRANSFER_PHRASES]),
        Topic("civil", V.CIVIL_TRIGGERS, V.CIVIL_PHRASES, V.CIVIL_MUST),
    )
    places: tuple = tuple(V.PLACES)
    merger: Topic = Topic("merger", [V.MERGER_MARKERS], V.MERGER_PHRASES)
    source: str = V.MERGER_SOURCE
    group_place: str = V.MERGER_GROUP_PLACE
    group: tuple = tuple(V.MERGER_GROUP)


VIETNAMESE = Boosts()


def query_features(queries: DataFrame, boosts: Boosts = VIETNAMESE) -> DataFrame:
    """Per query: places and numbers named, topics asked; queries are few, chunks are many."""
    low = F.lower(F.col("query"))
    numbers = F.filter(word_runs(low), lambda w: w.rlike(r"^[0-9]{2,4}$"))
    places = naming(low, lambda t: F.filter(strings(list(boosts.places)), lambda p: F.contains(t, p)))
    out = queries.withColumn("places", places).withColumn(
        "numbers", F.filter(numbers, lambda x: x.cast("int") >= 10)
    )
    out = out.withColumn("topics", F.array_compact(F.array(*[F.when(t.asked(low), F.lit(t.name)) for t in boosts.topics])))
    out = out.withColumn("merger", (F.size("places") > 0) & boosts.merger.asked(low))
    return out.withColumn("group_asked", F.contains(low, F.lit(boosts.group_place)) & F.array_contains("places", boosts.group_place))


def entity_amount(text_lower: Column) -> Column:
    count = lambda values: F.size(F.filter(values, lambda v: F.contains(text_lower, v)))
    return count(F.col("places")) * V.PLACE_BOOST + count(F.col("numbers")) * V.NUMBER_BOOST


def topic_amount(text_lower: Column, boosts: Boosts) -> Column:
    parts = [
        F.when(F.array_contains("topics", t.name), t.amount(text_lower)).otherwise(0.0) for t in boosts.topics
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _group_in(text_lower: Column, boosts: Boosts) -> Column:
    return F.col("group_asked") & all_of(text_lower, list(boosts.group))


def _places_in(text_lower: Column) -> Column:
    return F.forall(F.col("places"), lambda p: F.contains(text_lower, p))


def boost_amount(text_lower: Column, boosts: Boosts) -> Column:
    """Amount added to the fused score."""
    merger = F.when(_group_in(text_lower, boosts), F.lit(V.GROUP_BOOST)).otherwise(0.0) + boosts.merger.amount(text_lower)
    return entity_amount(text_lower) + topic_amount(text_lower, boosts) + F.when(F.col("merger"), merger).otherwise(0.0)


def bonus_amount(text_lower: Column, boosts: Boosts) -> Column:
    """Amount added to the rerank score."""
    merger = (
        F.when(_group_in(text_lower, boosts), F.lit(V.GROUP_BONUS))
        .when(_places_in(text_lower), F.lit(V.PLACES_BONUS))
        .otherwise(0.0)
    ) + boosts.merger.amount(text_lower)
    return topic_amount(text_lower, boosts) + F.when(F.col("merger"), merger).otherwise(0.0)


def forcing(text_lower: Column, features: DataFrame, boosts: Boosts = VIETNAMESE) -> Column:
    """Whether a text can be forced in by any of the queries, as far as the topics that some query asks tell."""
    flags = [F.max(F.array_contains("topics", t.name)) for t in boosts.topics] + [F.max("merger")]
    asked = features.agg(*flags).first()  # one row
    marks = [any_of(text_lower, t.must) for t, wanted in zip(boosts.topics, asked) if wanted and t.must]
    return reduce(lambda a, b: a | b, [*marks, F.contains(text_lower, F.lit(boosts.source)) if asked[-1] else F.lit(False)])


def with_text(ranked: DataFrame, chunks: DataFrame, bound: int, columns=("text",)) -> DataFrame:
    """Attach chunk columns to a ranked list of at most ``bound`` rows."""
    return lookup(ranked, chunks.select("chunk_id", *columns), ["chunk_id"], bound)


def boosted(
    ranked: DataFrame, queries: DataFrame, chunks: DataFrame, amount, bound: int, boosts: Boosts = VIETNAMESE
) -> DataFrame:
    """Ranked list with ``boost`` added to its score and ranked anew; ``amount(text_lower, boosts)``."""
    features = query_features(queries, boosts)
    joined = with_text(ranked, chunks, bound).join(features, "query_id")
    # lower case first, as every phrase reads it
    lowered = joined.withColumn("low", F.lower("text")).drop("text")
    out = lowered.withColumn("boost", amount(F.col("low"), boosts))
    return R.top_ranked(
        out.select("query_id", "chunk_id", "boost", (F.col("score") + F.col("boost")).alias("score"))
    )


def forcing_keys(features: DataFrame) -> DataFrame:
    """(query_id, key): what a query forces in: its topics, its set of places, and the group of units where it asks for that."""
    places = F.when(F.col("merger"), F.concat(F.lit("places:"), F.array_join("places", ",")))
    group = F.when(F.col("merger") & F.col("group_asked"), F.lit("group"))
    topics = F.transform("topics", lambda t: F.concat(F.lit("topic:"), t))
    return features.select("query_id", F.explode(F.array_compact(F.concat(topics, F.array(places, group)))).alias("key"))


def forced_chunks(features: DataFrame, chunks: DataFrame, boosts: Boosts = VIETNAMESE) -> DataFrame:
    """(key, chunk_id, score) of every chunk that a key of ``forcing_keys`` forces in; one row for each, however many queries share the key."""
    low = F.col("low")
    chunks = chunks.select("chunk_id", F.lower("text").alias("low"))
    flags = [F.when(any_of(low, t.must), F.lit(f"topic:{t.name}")) for t in boosts.topics if t.must]
    source = F.contains(low, F.lit(boosts.source))
    group = F.when(source & all_of(low, list(boosts.group)), F.lit("group"))
    plain = chunks.select("chunk_id", F.explode(F.array_compact(F.array(*flags, group))).alias("key"))
    score = F.when(F.col("key") == "group", F.lit(V.MERGER_GROUP_SCORE)).otherwise(F.lit(V.MUST_SCORE))
    plain = plain.select("key", "chunk_id", score.alias("score"))
    # chunks of the merger source meet sets of places by the places that both name
    named = chunks.filter(source).select("chunk_id", F.explode(F.filter(strings(list(boosts.places)), lambda p: F.contains(low, p))).alias("place"))
    sets = features.filter("merger").select(F.concat(F.lit("places:"), F.array_join("places", ",")).alias("key"), "places").distinct()
    sets = sets.select("key", F.size("places").alias("need"), F.explode("places").alias("place"))
    whole = (
        sized_join(named, sets, ["place"], ["chunk_id"], measure=sets)
        .groupBy("key", "chunk_id", "need")
        .agg(F.count("*").alias("found"))
        .filter("found = need")
        .select("key", "chunk_id", F.lit(V.MERGER_SCORE).alias("score"))
    )
    return plain.unionByName(whole)


def must_include(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, boosts: Boosts = VIETNAMESE, cap: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks outside the ranked list that a query forces in.

    With ``cap``, for a list that is cut to so many rows later: a key then keeps its first ``cap`` chunks and as many more as the
    longest ranked list has, which is what the cut can still reach, as rows of a key have one score and ties go to the smaller chunk.
    """
    features = query_features(queries, boosts)
    forced = forced_chunks(features, chunks, boosts)
    if cap is not None:
        longest = ranked.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        # a literal bound: every task keeps so many rows of a key before they are shuffled
        forced = forced.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("chunk_id"))).filter(F.col("n") <= cap + longest)
    rows = forcing_keys(features).join(forced, "key").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    rows = rows.join(ranked, ["query_id", "chunk_id"], "left_anti")
    return rows if cap is None else R.top_ranked(rows, cap).drop("rank")


def candidate_union(ranked: DataFrame, forced: DataFrame) -> DataFrame:
    """Ranked list and forced rows not already in it, ranked together."""
    extra = forced.join(ranked, ["query_id", "chunk_id"], "left_anti")
    columns = ["query_id", "chunk_id", "score"]
    return R.top_ranked(ranked.select(*columns).unionByName(extra.select(*columns)))


def candidate_cap(ranked: DataFrame, cap: int = 50) -> DataFrame:
    return ranked.filter(F.col("rank") <= cap)


def prefix_dedup(ranked: DataFrame, text: str = "text", length: int | None = 200) -> DataFrame:
    """First candidate per raw text prefix, in rank order; without ``length`` the whole text counts, by hash."""
    prefix = F.sha2(F.col(text), 256) if length is None else F.left(F.col(text), F.lit(length))
    order = W.partitionBy("query_id", prefix).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


# ---- rerank decision --------------------------------------------------------


def skip_features(candidates: DataFrame, dense: DataFrame) -> DataFrame:
    """Per query: candidate count, best ids, scores and margins of both rankings.

    ``candidates`` carry ``rank`` within the kept list and ``score``, the fused score.
    """
    at = lambda rank, column: F.max(F.when(F.col("rank") == rank, F.col(column)))
    fused = (
        candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n"),
            at(1, "chunk_id").alias("top_id"),
            at(1, "score").alias("rrf_top"),
            (at(1, "score") - at(2, "score")).alias("rrf_margin"),
        )
    )
    near = dense.filter("rank <= 2").groupBy("query_id").agg(
        F.count("*").alias("dense_n"),
        at(1, "chunk_id").alias("dense_id"),
        at(1, "score").alias("dense_top"),
        (at(1, "score") - at(2, "score")).alias("dense_margin"),
    )
    return fused.join(near, "query_id", "left")


def skip_decision(features: DataFrame) -> DataFrame:
    """Add (skip, reason): first-stage results clear enough to go without pair scores."""
    enough = (F.col("n") >= 2) & (F.coalesce(F.col("dense_n"), F.lit(0)) >= 2)
    agree = F.col("top_id") == F.col("dense_id")
    strong = (F.col("dense_top") >= V.SKIP_STRONG_DENSE) & (F.col("dense_margin") >= V.SKIP_STRONG_MARGIN)
    confident = (
        (F.col("dense_top") >= V.SKIP_DENSE)
        & (F.col("dense_margin") >= V.SKIP_DENSE_MARGIN)
        & (F.col("rrf_top") >= V.SKIP_RRF)
        & (F.col("rrf_margin") >= V.SKIP_RRF_MARGIN)
    )
    reason = (
        F.when(~enough, F.lit(""))
        .when(~agree, F.lit("top_ranking_disagrees"))
        .when(strong, F.lit("strong_dense_match"))
        .when(confident, F.lit("confident"))
        .otherwise(F.lit("not_confident"))
    )
    return features.withColumn("skip", F.coalesce(enough & agree & (strong | confident), F.lit(False))).withColumn(
        "reason", reason
    )


def proxy_score(rank0: Column, dense: Column, rrf: Column) -> Column:
    """Score on the pair scorer's scale, from first-stage values; ``rank0`` counts from zero."""
    return F.lit(V.PROXY_SCORE) - rank0 * V.PROXY_STEP + F.greatest(dense, F.lit(0.0)) * V.PROXY_DENSE + rrf


def low_score_bypass(scored: DataFrame) -> DataFrame:
    """Add ``bypass``: the best pair score is low while the first stage is sure.

    ``scored``: query_id, chunk_id, rank, pair_score, dense_score, keyword_top_id, keyword_top_score.
    """
    per_query = scored.groupBy("query_id").agg(
        F.max("pair_score").alias("best"),
        F.min_by("dense_score", "rank").alias("top_dense"),
        F.min_by(
            F.when(F.col("keyword_top_id") == F.col("chunk_id"), F.col("keyword_top_score")).otherwise(0.0), "rank"
        ).alias("top_keyword"),
    )
    sure = (F.col("top_keyword") >= V.BYPASS_KEYWORD) | (F.col("top_dense") >= V.BYPASS_DENSE)
    return per_query.withColumn("bypass", (F.col("best") < V.BYPASS_BEST) & sure)


def token_overlap(query: Column, text: Column) -> Column:
    """Default pair score: share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    k_retrieve: int = 150,
    k_final: int = 15,
    cap: int = 50,
    boosts: Boosts = VIETNAMESE,
    scorer=token_overlap,
    first_stage: tuple | None = None,
    dedup_length: int | None = 200,
) -> DataFrame:
    """The full chain for a table of queries.

    Keyword and vector lists are fused, boosted, joined by forced chunks, capped, freed of
    prefix copies, then scored: by ``scorer(query, text)``, or by the proxy where the first
    stage is clear or the pair scores are all low. The topical bonus decides the last order.
    Without a ``scorer`` the fused score stands for the pair score, and nothing is skipped or bypassed.
    """
    # each list is read several times below: two corpus scans, stored once
    keyword, dense = first_stage or (
        stored(R.bm25_topk(chunks, queries, k_retrieve), "keyword"),
        stored(R.dense_topk(vectors, query_vectors, k_retrieve), "dense"),
    )
    n = queries.count()
    merged = stored(R.rrf_merge([keyword, dense]), "merged")
    # one scan of the corpus: the texts that are listed or can be forced in; all below reads these
    mark = forcing(F.lower("text"), query_features(queries, boosts), boosts)
    chunks = stored(maybe_listed(chunks.select("chunk_id", "text"), merged.select("chunk_id"), ["chunk_id"], 2 * k_retrieve * n, mark), "relevant")
    lifted = stored(boosted(merged, queries, chunks, boost_amount, 2 * k_retrieve * n, boosts), "fused")
    # forcing needs keyword results, as the fallback to the dense list knows no boosts
    forced = must_include(lifted, queries, chunks, boosts, cap).join(keyword.select("query_id").distinct(), "query_id", "left_semi")
    kept = candidate_cap(candidate_union(lifted, forced), cap)
    shortened = F.col("text") if dedup_length is None else F.left("text", F.lit(dedup_length))
    first = stored(prefix_dedup(with_text(kept, chunks.select("chunk_id", shortened.alias("text")), cap * n), length=dedup_length).drop("text"), "kept")
    candidates = stored(with_text(first, chunks, cap * n), "candidates")
    return rerank(candidates, keyword, dense, queries, k_final, boosts, scorer)


def rerank(
    candidates: DataFrame,
    keyword: DataFrame,
    dense: DataFrame,
    queries: DataFrame,
    k_final: int,
    boosts: Boosts = VIETNAMESE,
    scorer=token_overlap,
) -> DataFrame:
    """Final scores and order of ``candidates(query_id, chunk_id, text, score, rank)``."""
    decided = skip_decision(skip_features(candidates, dense)).select("query_id", "skip")
    top_keyword = keyword.filter("rank = 1").select(
        "query_id", F.col("chunk_id").alias("keyword_top_id"), F.col("score").alias("keyword_top_score")
    )
    dense_score = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    scored = (
        candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
        .join(dense_score, ["query_id", "chunk_id"], "left")
        .fillna(0.0, ["dense_score"])
        .join(query_features(queries, boosts), "query_id")
        .join(top_keyword, "query_id", "left")
        .withColumn("pair_score", scorer(F.col("query"), F.col("text")) if scorer else F.col("score"))
        .withColumn("low", F.lower("text"))
    )
    bypass = low_score_bypass(scored).select("query_id", "bypass")
    proxied = (F.col("skip") | F.col("bypass")) if scorer else F.lit(False)
    base = F.when(proxied, proxy_score(F.col("rank") - 1, F.col("dense_score"), F.col("score"))).otherwise(
        F.col("pair_score")
    )
    final = (
        scored.join(decided, "query_id")
        .join(bypass, "query_id")
        .select(
            "query_id",
            "chunk_id",
            F.col("dense_score").alias("score_retrieval"),
            (base + bonus_amount(F.col("low"), boosts)).alias("score_rerank"),
            proxied.alias("rerank_skipped"),
        )
    )
    return R.top_ranked(final, k_final, "score_rerank")


# ---- pair-score ordering ----------------------------------------------------


def rerank_topk(scored: DataFrame, k: int) -> DataFrame:
    """Order by pair score, keep ``k``; scores to four places."""
    out = R.top_ranked(scored, k, "pair_score")
    return out.withColumn("pair_score", F.round("pair_score", 4))


def rerank_head(scored: DataFrame, head: int, k: int) -> DataFrame:
    """Only the first ``head`` are reordered by pair score; the tail keeps its order without one."""
    in_head = F.col("rank") <= head
    out = scored.withColumn("pair_score", F.when(in_head, F.col("pair_score")))
    order = W.partitionBy("query_id").orderBy(
        (~in_head).cast("int"), F.round("pair_score", 9).desc_nulls_last(), F.col("rank")
    )
    return out.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)
