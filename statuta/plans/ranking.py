"""Queries over boosts, rerank decisions, hybrid search, mining, and ordered outputs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import collapsed
from statuta.operators import boosts as B
from statuta.operators import retrieval as R
from statuta.operators import store as ST
from statuta.plans import inputs as I
from statuta.plans.inputs import lit, sql_all, sql_any, sql_list, sql_strip, sql_tokens, sql_words
from statuta.plans.registry import query
from statuta.session import shared_folder
from statuta.sources.tables import table

K, CAP, FINAL = 50, 30, 10
BOOSTS = I.BOOSTS


def numbered_queries(spark, d):
    """Benchmark items, every second one naming a number."""
    n = F.col("query_id")
    suffix = F.when(n % 2 == 0, F.concat(F.lit(" "), (n * 7 + 5).cast("string"))).otherwise("")
    return I.queries(spark, d).withColumn("query", F.concat("query", suffix))


FEATURES = f"""feat AS (SELECT query_id, low, list_filter({sql_list(BOOSTS.places)}, lambda p: contains(low, p)) AS places,
  list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[0-9]{{2,4}}') AND try_cast(w AS INTEGER) >= 10) AS numbers,
  {" AND ".join(sql_any('low', g) for g in BOOSTS.topics[0].triggers)} AS t_first, {" AND ".join(sql_any('low', g) for g in BOOSTS.topics[1].triggers)} AS t_second,
  {sql_any('low', BOOSTS.merger.triggers[0])} AND {sql_any('low', BOOSTS.places)} AS merger, contains(low, {lit(BOOSTS.group_place)}) AS grp
  FROM (SELECT item_id AS query_id, lower(text || CASE WHEN item_id % 2 = 0 THEN ' ' || (item_id * 7 + 5) ELSE '' END) AS low FROM benchmark))"""
FEATURES_PLAIN = FEATURES.replace(" || CASE WHEN item_id % 2 = 0 THEN ' ' || (item_id * 7 + 5) ELSE '' END", "")


def sql_amount(topic, tl="tl"):
    return "(" + " + ".join(f"CASE WHEN contains({tl}, {lit(p)}) THEN {a}::DOUBLE ELSE 0 END" for p, a in topic.phrases) + ")"


SQL_ENTITY = "(len(list_filter(places, lambda p: contains(tl, p))) * 0.08::DOUBLE + len(list_filter(numbers, lambda p: contains(tl, p))) * 0.04::DOUBLE)"
SQL_TOPIC = f"(CASE WHEN t_first THEN {sql_amount(BOOSTS.topics[0])} ELSE 0 END + CASE WHEN t_second THEN {sql_amount(BOOSTS.topics[1])} ELSE 0 END)"
_GROUP = f"(grp AND {sql_all('tl', BOOSTS.group)})"
_PLACES = "len(list_filter(places, lambda p: NOT contains(tl, p))) = 0"
SQL_MERGER = f"(CASE WHEN merger THEN CASE WHEN {_GROUP} THEN 0.7::DOUBLE ELSE 0 END + {sql_amount(BOOSTS.merger)} ELSE 0 END)"
SQL_BONUS_MERGER = f"(CASE WHEN merger THEN CASE WHEN {_GROUP} THEN 0.8::DOUBLE WHEN {_PLACES} THEN 0.35::DOUBLE ELSE 0 END + {sql_amount(BOOSTS.merger)} ELSE 0 END)"
SQL_BOOST = f"({SQL_ENTITY} + {SQL_TOPIC} + {SQL_MERGER})"
SQL_BONUS = f"({SQL_TOPIC} + {SQL_BONUS_MERGER})"


def sql_boosted(amount, source="run"):
    return f"""lifted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, {amount} AS boost, score + {amount} AS score FROM (SELECT r.*, lower(text) AS tl FROM {source} r JOIN documents ON doc_id = chunk_id) JOIN feat USING (query_id)))"""


def boosted(spark, d, amount):
    run = I.rrf_run(spark, d)
    out = B.boosted(run, numbered_queries(spark, d), I.chunks(spark, d), amount, run.count(), BOOSTS)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("boost", 6).alias("boost"), F.round("score", 6).alias("score"))


_BOOSTED = "SELECT query_id, chunk_id, rank, round(boost, 6) AS boost, round(score, 6) AS score FROM lifted"


@query("entity_boost", f"WITH {I.RRF_RUN}, {FEATURES}, {sql_boosted(SQL_ENTITY)} {_BOOSTED}")
def entity_boost(spark, d):
    return boosted(spark, d, lambda low, boosts: B.entity_amount(low))


@query("topic_boost", f"WITH {I.RRF_RUN}, {FEATURES}, {sql_boosted(f'({SQL_TOPIC} + {SQL_MERGER})')} {_BOOSTED}")
def topic_boost(spark, d):
    return boosted(spark, d, lambda low, boosts: B.boost_amount(low, boosts) - B.entity_amount(low))


@query("topical_bonus", f"WITH {I.RRF_RUN}, {FEATURES}, {sql_boosted(SQL_BONUS)} {_BOOSTED}")
def topical_bonus(spark, d):
    return boosted(spark, d, B.bonus_amount)


ALL_FORCED = f"""forced AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM (
  SELECT query_id, doc_id AS chunk_id, CASE WHEN merger AND contains(tl, {lit(BOOSTS.source)}) AND {_GROUP} THEN 1.3::DOUBLE WHEN merger AND contains(tl, {lit(BOOSTS.source)}) AND {_PLACES} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS score
  FROM feat, (SELECT doc_id, lower(text) AS tl FROM documents)
  WHERE ((t_first AND {sql_any('tl', BOOSTS.topics[0].must)}) OR (t_second AND {sql_any('tl', BOOSTS.topics[1].must)})
    OR (merger AND contains(tl, {lit(BOOSTS.source)}) AND ({_GROUP} OR {_PLACES}))) AND (query_id, doc_id) NOT IN (SELECT (query_id, chunk_id) FROM base))) WHERE true)"""
FORCED = ALL_FORCED.replace("WHERE true)", f"WHERE n <= {CAP})")


@query("must_include", f"WITH {I.RRF_RUN}, {FEATURES}, base AS (SELECT query_id, chunk_id FROM run), {ALL_FORCED} SELECT query_id, chunk_id, score FROM forced")
def must_include(spark, d):
    return B.must_include(I.rrf_run(spark, d), numbered_queries(spark, d), I.chunks(spark, d), BOOSTS)


@query("candidate_union_except", f"""WITH {I.RRF_RUN}, t AS (SELECT * FROM bm25 WHERE rank <= 10), x AS (SELECT query_id, chunk_id, score FROM run UNION ALL SELECT query_id, chunk_id, 0.5::DOUBLE FROM dense d
  WHERE rank <= 30 AND chunk_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM run r WHERE r.query_id = d.query_id AND r.chunk_id = d.chunk_id))
SELECT query_id, chunk_id, round(x.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(x.score, 9) DESC, chunk_id) AS rank FROM x""")
def candidate_union_except(spark, d):
    dense = R.dense_topk(I.chunk_vectors(spark, d), I.query_vectors(spark, d), 30).filter("chunk_id % 3 = 0")
    out = B.candidate_union(I.rrf_run(spark, d), dense.withColumn("score", F.lit(0.5)))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("candidate_cap", f"""WITH {I.RRF_RUN}, x AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, substr(text, 1, 200) ORDER BY rank) AS n
  FROM run JOIN documents ON doc_id = chunk_id WHERE rank <= 12) SELECT query_id, chunk_id, rank FROM x WHERE n = 1""")
def candidate_cap(spark, d):
    capped = B.candidate_cap(I.rrf_run(spark, d), 12)
    bound = I.queries(spark, d).count() * 12
    starts = I.chunks(spark, d).select("chunk_id", F.left("text", F.lit(200)).alias("text"))
    out = B.prefix_dedup(B.with_text(capped, starts, bound))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("dense_only_fallback", f"""WITH {I.BM25}, {I.DENSE}, x AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 10 AND query_id % 2 = 0
  UNION ALL SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 10) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM x""")
def dense_only_fallback(spark, d):
    out = R.dense_only_fallback(I.bm25_run(spark, d).filter("query_id % 2 = 0"), I.dense_run(spark, d))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SKIP = """fu AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN chunk_id END) AS top_id, max(CASE WHEN rank = 1 THEN score END) AS rrf_top,
  max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS rrf_margin FROM cand GROUP BY query_id),
de AS (SELECT query_id, count(*) AS dense_n, max(CASE WHEN rank = 1 THEN chunk_id END) AS dense_id, max(CASE WHEN rank = 1 THEN score END) AS dense_top,
  max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS dense_margin FROM dn WHERE rank <= 2 GROUP BY query_id),
sk AS (SELECT *, n >= 2 AND coalesce(dense_n, 0) >= 2 AS enough, coalesce(dense_top >= 0.5 AND dense_margin >= 0.08, false) AS strong,
  coalesce(dense_top >= 0.7 AND dense_margin >= 0.1 AND rrf_top >= 0.032 AND rrf_margin >= 0.0004, false) AS confident FROM fu LEFT JOIN de USING (query_id)),
skip AS (SELECT *, coalesce(enough AND top_id = dense_id AND (strong OR confident), false) AS skip,
  CASE WHEN NOT enough THEN '' WHEN top_id <> dense_id THEN 'top_ranking_disagrees' WHEN strong THEN 'strong_dense_match' WHEN confident THEN 'confident' ELSE 'not_confident' END AS reason FROM sk)"""


@query("rerank_skip", f"""WITH {I.RRF_RUN}, cand AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM run WHERE query_id % 2 = 0 OR chunk_id IN (SELECT chunk_id FROM dense WHERE rank <= 10)),
dn AS (SELECT * FROM dense WHERE rank <= 10), {SKIP}
SELECT query_id, n, top_id, dense_id, round(dense_top, 6) AS dense_top, round(dense_margin, 6) AS dense_margin, round(rrf_top, 6) AS rrf_top, skip, reason FROM skip""")
def rerank_skip(spark, d):
    run = I.rrf_run(spark, d)
    near = I.dense_run(spark, d).select("chunk_id").distinct().withColumn("near", F.lit(True))
    candidates = run.join(near, "chunk_id", "left").filter((F.col("query_id") % 2 == 0) | F.col("near"))
    out = B.skip_decision(B.skip_features(candidates, I.dense_run(spark, d)))
    rounded = [F.round(c, 6).alias(c) for c in ("dense_top", "dense_margin", "rrf_top")]
    return out.select("query_id", "n", "top_id", "dense_id", *rounded, "skip", "reason")


@query("proxy_scores", f"""WITH {I.RRF_RUN} SELECT r.query_id, r.chunk_id, round(8.0::DOUBLE - (r.rank - 1) * 0.05::DOUBLE + greatest(coalesce(d.score, 0), 0) * 0.01::DOUBLE + r.score, 6) AS score
FROM run r LEFT JOIN (SELECT * FROM dense WHERE rank <= 10) d USING (query_id, chunk_id)""")
def proxy_scores(spark, d):
    dense = I.dense_run(spark, d).select("query_id", "chunk_id", F.col("score").alias("dense"))
    out = I.rrf_run(spark, d).join(dense, ["query_id", "chunk_id"], "left").fillna(0.0, ["dense"])
    return out.select("query_id", "chunk_id", F.round(B.proxy_score(F.col("rank") - 1, F.col("dense"), F.col("score")), 6).alias("score"))


def with_pairs(spark, d, run):
    """Run rows with the default pair score."""
    texts = B.with_text(run, I.chunks(spark, d), run.count())
    return texts.join(I.queries(spark, d), "query_id").withColumn("pair_score", B.token_overlap(F.col("query"), F.col("text"))).drop("text", "query")


PAIRS = f"""qtok AS (SELECT item_id AS query_id, list_distinct({sql_tokens('text')}) AS qt FROM benchmark), ttok AS (SELECT doc_id AS chunk_id, {sql_tokens('text')} AS tt FROM documents),
pairs AS (SELECT r.*, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, tt)) / len(qt)::DOUBLE END AS pair_score FROM run r JOIN qtok USING (query_id) JOIN ttok USING (chunk_id))"""


@query("pair_score", f"WITH {I.RRF_RUN}, {PAIRS} SELECT query_id, chunk_id, round(pair_score, 6) AS pair_score FROM pairs")
def pair_score(spark, d):
    return with_pairs(spark, d, I.rrf_run(spark, d)).select("query_id", "chunk_id", F.round("pair_score", 6).alias("pair_score"))


@query("rerank_topk", f"""WITH {I.RRF_RUN}, {PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pair_score, 9) DESC, chunk_id) AS new_rank FROM pairs)
SELECT query_id, chunk_id, new_rank AS rank, round(pair_score, 4) AS pair_score FROM x WHERE new_rank <= 5""")
def rerank_topk(spark, d):
    out = B.rerank_topk(with_pairs(spark, d, I.rrf_run(spark, d)), 5)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "pair_score")


@query("rerank_head_keep_tail", f"""WITH {I.RRF_RUN}, {PAIRS}, x AS (SELECT query_id, chunk_id, rank, CASE WHEN rank <= 6 THEN pair_score END AS p FROM pairs),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 6 THEN 0 ELSE 1 END, round(p, 9) DESC NULLS LAST, rank) AS new_rank FROM x)
SELECT query_id, chunk_id, rank, new_rank, round(p, 6) AS pair_score FROM y WHERE new_rank <= 9""")
def rerank_head_keep_tail(spark, d):
    out = B.rerank_head(with_pairs(spark, d, I.rrf_run(spark, d)), 6, 9)
    longs = [F.col(c).cast("long").alias(c) for c in ("rank", "new_rank")]
    return out.select("query_id", "chunk_id", *longs, F.round("pair_score", 6).alias("pair_score"))


@query("low_score_bypass", f"""WITH {I.RRF_RUN}, {PAIRS}, x AS (SELECT p.query_id, p.chunk_id, p.rank, pair_score * (p.query_id % 4) * 0.1::DOUBLE AS pair_score, coalesce(d.score, 0) AS dense_score, b.chunk_id AS kid, b.score AS ks
  FROM pairs p LEFT JOIN (SELECT * FROM dense WHERE rank <= 10) d USING (query_id, chunk_id) LEFT JOIN (SELECT * FROM bm25 WHERE rank = 1) b ON b.query_id = p.query_id),
y AS (SELECT query_id, max(pair_score) AS best, arg_min(dense_score, rank) AS top_dense, arg_min(CASE WHEN kid = chunk_id THEN ks ELSE 0 END, rank) AS top_keyword FROM x GROUP BY query_id)
SELECT query_id, round(best, 6) AS best, round(top_dense, 6) AS top_dense, round(top_keyword, 6) AS top_keyword, best < 0.15 AND (top_keyword >= 10 OR top_dense >= 0.45) AS bypass FROM y""")
def low_score_bypass(spark, d):
    keyword, near = I.bm25_run(spark, d), I.dense_run(spark, d)
    dense = near.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    top = keyword.filter("rank = 1").select("query_id", F.col("chunk_id").alias("keyword_top_id"), F.col("score").alias("keyword_top_score"))
    x = (
        with_pairs(spark, d, I.fused_run(keyword, near)).withColumn("pair_score", F.col("pair_score") * (F.col("query_id") % 4) * 0.1)
        .join(dense, ["query_id", "chunk_id"], "left").fillna(0.0, ["dense_score"]).join(top, "query_id", "left")
    )
    rounded = [F.round(c, 6).alias(c) for c in ("best", "top_dense", "top_keyword")]
    return B.low_score_bypass(x).select("query_id", *rounded, "bypass")


HYBRID = f"""{I.BM25}, {I.DENSE}, {I.sql_rrf(K)}, {FEATURES_PLAIN}, {sql_boosted(SQL_BOOST, 'rrf')},
base AS (SELECT query_id, chunk_id FROM lifted), {FORCED},
uni AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score FROM lifted UNION ALL SELECT query_id, chunk_id, score FROM forced)),
ded AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(text, 1, 200) ORDER BY rank) AS nth FROM uni JOIN documents ON doc_id = chunk_id WHERE rank <= {CAP}),
cand AS (SELECT query_id, chunk_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ded WHERE nth = 1),
dn AS (SELECT * FROM dense WHERE rank <= {K}), {SKIP},
run AS (SELECT * FROM cand), {PAIRS},
sc AS (SELECT p.query_id, p.chunk_id, p.rank, p.score, p.pair_score, lower(p.text) AS tl, coalesce(d.score, 0) AS dense_score, b.chunk_id AS kid, b.score AS ks, s.skip
  FROM pairs p LEFT JOIN dn d USING (query_id, chunk_id) LEFT JOIN (SELECT * FROM bm25 WHERE rank = 1) b ON b.query_id = p.query_id JOIN skip s ON s.query_id = p.query_id),
bp AS (SELECT query_id, max(pair_score) < 0.15 AND (arg_min(CASE WHEN kid = chunk_id THEN ks ELSE 0 END, rank) >= 10 OR arg_min(dense_score, rank) >= 0.45) AS bypass FROM sc GROUP BY query_id),
fin AS (SELECT query_id, chunk_id, dense_score, skip OR bypass AS proxied, CASE WHEN skip OR bypass THEN 8.0::DOUBLE - (rank - 1) * 0.05::DOUBLE + greatest(dense_score, 0) * 0.01::DOUBLE + score ELSE pair_score END + {SQL_BONUS} AS score_rerank
  FROM sc JOIN bp USING (query_id) JOIN feat USING (query_id)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score_rerank, 9) DESC, chunk_id) AS rank FROM fin)"""


def hybrid(spark, d, k_final=FINAL, queries=None, query_vectors=None, first_stage=None):
    return B.hybrid_search(
        I.chunks(spark, d), I.chunk_vectors(spark, d), queries if queries is not None else I.queries(spark, d),
        query_vectors if query_vectors is not None else I.query_vectors(spark, d), K, k_final, CAP, BOOSTS, first_stage=first_stage,
    )


def shown_hybrid(df):
    return df.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score_retrieval", 6).alias("score_retrieval"),
        F.round("score_rerank", 6).alias("score_rerank"), "rerank_skipped",
    )


@query("hybrid_search", f"WITH {HYBRID} SELECT query_id, chunk_id, rank, round(dense_score, 6) AS score_retrieval, round(score_rerank, 6) AS score_rerank, proxied AS rerank_skipped FROM hybrid WHERE rank <= {FINAL}")
def hybrid_search(spark, d):
    return shown_hybrid(hybrid(spark, d))


@query("query_dedup_batch", f"""WITH {I.BM25}, q AS (SELECT conv_id * 1000 + turn AS query_id, (conv_id + turn) % (SELECT count(*) FROM benchmark) AS item FROM conversations WHERE role = 'user')
SELECT q.query_id, chunk_id, rank, round(score, 6) AS score FROM q JOIN bm25 ON bm25.query_id = item WHERE rank <= 5""")
def query_dedup_batch(spark, d):
    n = table(spark, d, "benchmark").agg(F.count("*")).scalar()
    asked = I.turns(spark, d, "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), ((F.col("conv_id") + F.col("turn")) % n).alias("item_id"), "turn"
    )
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), "text", F.lit("  "))).otherwise(F.col("text"))
    queries = asked.join(table(spark, d, "benchmark"), "item_id").select("query_id", text.alias("query"))
    chunks = I.chunks(spark, d)
    out = R.query_dedup(queries, collapsed(F.col("query")), lambda q: R.bm25_topk(chunks, q, 5))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("hard_negatives", f"""WITH {I.DENSE}, b AS (SELECT item_id AS query_id, text AS passage, list_distinct({sql_words('lower(text)')}) AS pw FROM benchmark),
n AS (SELECT d.query_id, d.chunk_id, d.rank, t.text FROM dense d JOIN documents t ON t.doc_id = d.chunk_id JOIN b USING (query_id)
  WHERE rank > 10 AND rank <= 30 AND NOT (len(pw) > 0 AND len(list_intersect(pw, {sql_words('lower(t.text)')})) / len(pw)::DOUBLE > 0.9)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM n),
o AS (SELECT query_id, CAST(NULL AS BIGINT) AS chunk_id, passage, 1 AS label, 0::BIGINT AS pick FROM b UNION ALL SELECT query_id, chunk_id, text, 0, pick FROM p WHERE pick <= 2)
SELECT query_id, chunk_id, md5(passage) AS passage_md5, label, pick, count(*) FILTER (label = 1) OVER () AS n_pos, count(*) FILTER (label = 0) OVER () AS n_neg,
  (SELECT count(*) FROM b WHERE query_id NOT IN (SELECT query_id FROM o WHERE label = 0)) AS n_without FROM o""")
def hard_negatives(spark, d):
    positives = I.queries(spark, d).select("query_id", F.col("query").alias("passage"))
    near = R.dense_topk(I.chunk_vectors(spark, d), I.query_vectors(spark, d), 30)
    mined = R.hard_negatives(positives, near, I.chunks(spark, d))
    counts = R.mining_counts(mined)
    return mined.select("query_id", "chunk_id", F.md5("passage").alias("passage_md5"), "label", F.col("pick").cast("long").alias("pick")).withColumn(
        "c", counts.select(F.struct("*")).scalar()
    ).select("*", "c.*").drop("c")


# ---- orders, samples, set operations ----------------------------------------


@query("conversation_order", """WITH u AS (SELECT conv_id, max(turn) * 100 + conv_id % 7 AS updated FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, row_number() OVER (ORDER BY updated DESC, conv_id) AS conv_pos FROM u)
SELECT conv_id, conv_pos, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_pos FROM conversations JOIN p USING (conv_id)""")
def conversation_order(spark, d):
    messages = table(spark, d, "conversations")
    convs = messages.groupBy("conv_id").agg(F.max("turn").alias("t")).select("conv_id", (F.col("t") * 100 + F.col("conv_id") % 7).alias("updated_at"))
    return ST.conversation_order(convs, messages)


@query("seeded_sample", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def seeded_sample(spark, d):
    positives = table(spark, d, "labels").filter("quality = 1")
    return ST.seeded_sample(positives, "doc_id", 200, 42)


@query("corpus_append", """SELECT doc_id, text, source, doc_id < 300 AS is_old, row_number() OVER (ORDER BY doc_id >= 300, doc_id) - 1 AS chunk_id FROM documents""")
def corpus_append(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text", "source", (F.col("doc_id") < 300).alias("is_old"))
    old = docs.filter("is_old").withColumn("chunk_id", F.col("doc_id"))
    return ST.corpus_append(old, docs.filter("NOT is_old"), "doc_id")


@query("doc_delete", f"""WITH k AS (SELECT doc_id, text FROM documents WHERE source <> 'src3' OR source IS NULL)
SELECT (SELECT count(*) FROM documents WHERE source = 'src3') AS n_deleted, (SELECT count(*) FROM k) AS n_chunks, (SELECT count(*) FROM k) AS n_vectors, (SELECT count(*) FROM k WHERE len({I.sql_tokens('text')}) > 0) AS n_postings,
  (SELECT CAST(sum(doc_id) AS BIGINT) FROM k) AS id_sum, (SELECT CAST(sum(doc_id) AS BIGINT) FROM k) AS vector_id_sum, true AS consistent, true AS unknown_is_error""")
def doc_delete(spark, d):
    """Publish a store without the documents of one source, read it back, and try to delete them again."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    before = ST.commit(spark, root, I.chunks(spark, d), I.chunk_vectors(spark, d))
    target = F.col("van_ban") == "src3"
    n = ST.read_version(spark, root, before)["chunks"].filter(target).count()
    after = ST.delete(spark, root, target)
    try:
        ST.delete(spark, root, target)
        refused = False
    except LookupError:
        refused = ST.current_version(spark, root) == after
    tables = ST.read_version(spark, root, after)
    sums = {name: tables[name].agg(F.sum("chunk_id")).scalar() for name in ("chunks", "vectors")}
    return ST.store_stats(tables).withColumns(
        {"n_deleted": F.lit(n).cast("long"), "id_sum": sums["chunks"], "vector_id_sum": sums["vectors"], "unknown_is_error": F.lit(refused)}
    )


@query("conversation_delete", """SELECT conv_id, count(*) AS n_messages FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id""")
def conversation_delete(spark, d):
    messages = table(spark, d, "conversations")
    convs = messages.select("conv_id").distinct()
    kept, left = ST.conversation_delete(convs, messages, convs.filter("conv_id % 10 = 3"))
    return kept.join(left.groupBy("conv_id").agg(F.count("*").alias("n_messages")), "conv_id")
