"""Joins of the corpus with expectations, citations, stores and phrases."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.citations import blank, matches
from statuta.functions.text import bare_key
from statuta.joins import BROADCAST_ROWS, lookup, maybe_listed, sized_join, within
from statuta.session import stored
from statuta.unfold import unfold


def cascade_enrich(corpus: DataFrame, known: DataFrame, heuristics: list[tuple[Column, str]]) -> DataFrame:
    """Fill an empty ``source_file`` from ``known``: by text, then by place in the law, then by rule.

    ``corpus(text, van_ban, dieu, khoan, chunk_index, source_file)``,
    ``known(pos, text, van_ban, dieu, khoan, chunk_index, source_file, page_number)``.
    The last known row of a key counts; keys are hashed, so long texts do not travel twice.
    """
    by_text = F.md5(bare_key(F.col("text")))
    by_place = F.md5(
        F.concat_ws("|", *[bare_key(F.col(c)) for c in ("van_ban", "dieu", "khoan")], F.col("chunk_index").cast("string"))
    )
    value = F.struct("source_file", "page_number")
    known = known.filter((F.coalesce("text", F.lit("")) != "") & ~blank(F.col("source_file")))
    texts = known.groupBy(by_text.alias("_text_key")).agg(F.max_by(value, "pos").alias("_by_text"))
    places = known.groupBy(by_place.alias("_place_key")).agg(F.max_by(value, "pos").alias("_by_place"))
    empty = blank(F.col("source_file"))
    # rows that need nothing get keys of their own: they match nothing and do not meet in one task
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    out = (
        corpus.withColumn("_text_key", F.when(empty, by_text).otherwise(own))
        .withColumn("_place_key", F.when(empty, by_place).otherwise(own))
        .join(texts, "_text_key", "left")
        .join(places, "_place_key", "left")
    )
    found = F.coalesce("_by_text", "_by_place")
    guess = F.coalesce(*[F.when(test, F.lit(name)) for test, name in heuristics], F.lit(""))
    return out.withColumn("enriched", empty & found.isNotNull()).withColumn(
        "source_file", F.when(~empty, F.col("source_file")).otherwise(F.coalesce(found["source_file"], guess))
    ).withColumn("page_number", F.when(F.col("enriched"), F.coalesce(found["page_number"], F.lit(1))).otherwise(F.col("page_number"))).drop(
        "_text_key", "_place_key", "_by_text", "_by_place"
    )


def hit_join(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results`` with ``hit``: same chunk number (unless -1), or same title, article and clause.

    Each way is an equi-join against the distinct keys of the expectations.
    """
    e = expected.select("query_id", F.explode("expected_citations").alias("e")).select("query_id", "e.*")
    by_id = e.filter(F.coalesce("chunk_index", F.lit(-1)) != -1).select("query_id", "chunk_index").distinct().withColumn("_id", F.lit(True))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    by_place = e.select("query_id", text("van_ban"), text("dieu"), text("khoan")).distinct().withColumn("_place", F.lit(True))
    out = results.join(by_id, ["query_id", "chunk_index"], "left").join(by_place, ["query_id", "van_ban", "dieu", "khoan"], "left")
    hit = F.coalesce("_id", F.lit(False)) | F.coalesce("_place", F.lit(False))
    return out.withColumn("hit", hit).drop("_id", "_place")


def chunk_citation_match(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results`` with ``matched``: expected chunk number, or expected article and, where given, clause."""
    e = expected.select("query_id", F.explode("expected_citations").alias("e")).select("query_id", "e.*")
    by_id = e.filter("chunk_index is not null").select("query_id", F.col("chunk_index").alias("chunk_id")).distinct().withColumn("_id", F.lit(True))
    article = e.filter(~blank(F.col("dieu")))
    whole = article.filter(blank(F.col("khoan"))).select("query_id", "dieu").distinct().withColumn("_whole", F.lit(True))
    part = article.filter(~blank(F.col("khoan"))).select("query_id", "dieu", "khoan").distinct().withColumn("_part", F.lit(True))
    out = (
        results.join(by_id, ["query_id", "chunk_id"], "left")
        .join(whole, ["query_id", "dieu"], "left")
        .join(part, ["query_id", "dieu", "khoan"], "left")
    )
    any_flag = F.coalesce("_id", F.lit(False)) | F.coalesce("_whole", F.lit(False)) | F.coalesce("_part", F.lit(False))
    return out.withColumn("matched", any_flag).drop("_id", "_whole", "_part")


def citation_pairs(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Matching (query_id, out_no, exp_no) of an answer's citations and the expected ones.

    A match has equal articles or none on both sides, so the article, empty for none, is a join key.
    """
    key = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias("_article")
    o = outputs.select("query_id", "out_no", "dieu", "khoan", "diem", key("dieu"))
    e = expected.select(
        "query_id", "exp_no", F.col("dieu").alias("e_dieu"), F.col("khoan").alias("e_khoan"), F.col("diem").alias("e_diem"), key("dieu")
    )
    same = matches(*[F.col(c) for c in ("dieu", "khoan", "diem", "e_dieu", "e_khoan", "e_diem")])
    return o.join(e, ["query_id", "_article"]).filter(same).select("query_id", "out_no", "exp_no")


def citation_backfill(citations: DataFrame, ranked: DataFrame) -> DataFrame:
    """Title, page and source of citations without a title, from the query's ranked chunks.

    ``citations(query_id, cite_no, van_ban, dieu, khoan)``, ``ranked(query_id, rank, van_ban, dieu, khoan, page_number, source_file)``.
    Best is a chunk of the same article and clause, then article, then the first chunk.
    A chunk with no title gives nothing.
    """
    names = ["van_ban", "dieu", "khoan", "page_number", "source_file"]
    c = ranked.select("query_id", "rank", *[F.col(x).alias("c_" + x) for x in names])
    both = lambda a, b: ~blank(F.col(a)) & ~blank(F.col(b)) & (F.col(a) == F.col(b))
    article = both("dieu", "c_dieu")
    klass = F.when(article & both("khoan", "c_khoan"), 1).when(article, 2).when((F.col("rank") == 1) & ~blank(F.col("c_van_ban")), 3)
    need = blank(F.col("van_ban")) | (F.col("van_ban") == "N/A")
    open_ = citations.filter(need)
    best = (
        open_.join(c, "query_id")
        .withColumn("_class", klass)
        .filter("_class is not null")
        .groupBy("query_id", "cite_no")
        .agg(F.min_by(F.struct("c_van_ban", "c_page_number", "c_source_file"), F.struct("_class", "rank")).alias("_best"))
    )
    out = citations.join(best, ["query_id", "cite_no"], "left")
    use = need & ~blank(F.col("_best.c_van_ban"))
    use = F.coalesce(use, F.lit(False))
    return out.select(
        "query_id", "cite_no", F.when(use, F.col("_best.c_van_ban")).otherwise(F.col("van_ban")).alias("van_ban"), "dieu", "khoan",
        F.when(use, F.col("_best.c_page_number")).alias("page_number"), F.when(use, F.col("_best.c_source_file")).alias("source_file"),
    )


def duplicate_check(files: DataFrame, store: DataFrame) -> DataFrame:
    """``files(file_id, doc_id, sha256)`` with the number of stored chunks of the same document or content.

    ``store(doc_id, sha256)`` is counted per document, per content and per both: a file's number is that of its document
    and that of its content less that of both, so no file meets the single contents of its document.
    """
    counts = store.groupBy("doc_id", "sha256").agg(F.count("*").alias("n"))
    asked = files.filter(F.col("file_id").isNotNull())
    by_doc = asked.select("file_id", "doc_id").distinct()
    by_sha = asked.select("file_id", "sha256").distinct()
    total = lambda *keys: counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    parts = [
        by_doc.join(total("doc_id"), "doc_id").select("file_id", "n"),
        by_sha.join(total("sha256"), "sha256").select("file_id", "n"),
        # what both ways found counts once
        by_doc.join(by_sha, "file_id").join(counts, ["doc_id", "sha256"]).select("file_id", (-F.col("n")).alias("n")),
    ]
    found = reduce(DataFrame.unionByName, parts).groupBy("file_id").agg(F.sum("n").alias("stored_chunks"))
    out = files.join(found, "file_id", "left").fillna(0, ["stored_chunks"])
    return out.withColumn("already_exists", F.col("stored_chunks") > 0)


#: A text is read as runs of word characters and runs of others.
_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_GRAM = 3


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))


def _grams(run: str) -> Column:
    """(kind, gram) of a run: its first and last 1 to ``_GRAM`` characters, and all ranges of that many characters."""
    size = F.length(run)
    n = lambda k: F.lit(k)
    starts = [F.struct(F.lit("start").alias("kind"), F.left(run, n(k)).alias("gram")) for k in range(1, _GRAM + 1)]
    ends = [F.struct(F.lit("end").alias("kind"), F.right(run, n(k)).alias("gram")) for k in range(1, _GRAM + 1)]

    def inside(k: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1)))
        return F.transform(at, lambda i: F.struct(F.lit("inside").alias("kind"), F.substring(F.col(run), i, n(k)).alias("gram")))

    return F.array_distinct(F.concat(F.array(*starts, *ends), *map(inside, range(1, _GRAM + 1))))


def phrase_anchors(low: DataFrame, phrases: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(phrase, run): the runs of which a text must have one to hold the phrase; those of the phrase's place where they are rarest.

    A run inside a phrase is a whole run of any text that holds it. The first run of a phrase ends a run of the text, the last one
    starts one, and the only one lies in one; the runs of the corpus that do are found by 3-grams.
    """
    vocabulary = stored(unfold(low, [], F.array_distinct(_runs(F.col("low"))), "run").groupBy("run").agg(F.count("*").alias("df")), "runs")
    placed = phrases.select("phrase", F.size(_runs(F.col("phrase"))).alias("n"), F.posexplode(_runs(F.col("phrase"))).alias("place", "own"))
    kind = F.when(F.col("n") == 1, "inside").when(F.col("place") == 0, "end").when(F.col("place") == F.col("n") - 1, "start").otherwise("whole")
    placed = stored(placed.select("phrase", "place", "own", kind.alias("kind")), "places")
    whole = placed.filter("kind = 'whole'").select("phrase", "place", F.col("own").alias("run"))
    whole = sized_join(vocabulary, whole, ["run"], ["df"], measure=whole, rows=rows).select("phrase", "place", "run", "df")
    gram = F.when(F.col("kind") == "end", F.right("own", F.lit(_GRAM))).otherwise(F.left("own", F.lit(_GRAM)))
    edges = placed.filter("kind <> 'whole'").select("phrase", "place", "own", "kind", gram.alias("gram"))
    split = unfold(vocabulary, ["run", "df"], _grams("run"), "g").select("run", "df", "g.*")
    fits = (
        F.when(F.col("kind") == "end", F.endswith("run", "own")).when(F.col("kind") == "start", F.startswith("run", "own")).otherwise(F.contains("run", "own"))
    )
    edge = sized_join(split, edges, ["kind", "gram"], ["run"], measure=edges, rows=rows).filter(fits).select("phrase", "place", "run", "df")
    found = stored(whole.unionByName(edge), "anchors")
    # a place that no text fills has no cost, and leaves its phrase without anchors
    cost = placed.select("phrase", "place").join(found.groupBy("phrase", "place").agg(F.sum("df").alias("cost")), ["phrase", "place"], "left")
    best = cost.groupBy("phrase").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "place")).alias("b"))
    return stored(found.join(best.select("phrase", F.col("b.place").alias("place")), ["phrase", "place"], "left_semi").select("phrase", "run"), "chosen")


def phrase_scan(chunks: DataFrame, phrases: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(phrase_id, chunk_id) of chunks whose lower-case text holds the phrase, a row for each row of either table.

    Texts meet phrases by the rarest runs of the phrases, and what meets is looked through. Where the anchors are within ``rows`` they
    are broadcast and a text is looked through in its row; else only runs are shuffled, then the texts that met some phrase.
    An empty phrase is in every text.
    """
    phrases = phrases.select("phrase_id", "phrase").filter(F.col("phrase").isNotNull())
    wanted = stored(phrases.select("phrase").distinct(), "phrases")
    low = chunks.filter(F.col("text").isNotNull()).select("chunk_id", F.lower("text").alias("low"))
    anchors = phrase_anchors(low, wanted.filter(F.col("phrase") != ""), rows)
    numbered = low.withColumn("row", F.monotonically_increasing_id())
    distinct = F.array_distinct(_runs(F.col("low")))
    if within(anchors, rows):
        met = unfold(numbered, ["row", "chunk_id", "low"], distinct, "run").join(F.broadcast(anchors), "run")
        held = met.filter(F.contains("low", "phrase")).select("row", "chunk_id", "phrase").distinct()
    else:
        met = sized_join(unfold(low, ["chunk_id"], distinct, "run"), anchors, ["run"], ["chunk_id"]).select("chunk_id", "phrase").distinct()
        met = stored(met, "met")
        texts = maybe_listed(numbered, met.select("chunk_id"), ["chunk_id"], met.count())
        held = texts.join(met, "chunk_id").filter(F.contains("low", "phrase")).select("row", "chunk_id", "phrase")
    held = held.select("chunk_id", "phrase")
    if not wanted.filter("phrase = ''").isEmpty():
        held = held.unionByName(low.select("chunk_id", F.lit("").alias("phrase")))
    return sized_join(held, phrases, ["phrase"], ["chunk_id"], measure=phrases, rows=rows).select("phrase_id", "chunk_id")


def conversation_join(users: DataFrame, conversations: DataFrame, messages: DataFrame, owner: Column) -> DataFrame:
    """Messages of the conversations whose owner passes ``owner``; owners are filtered before messages are read."""
    mine = conversations.join(users.filter(owner).select("user_id", "name"), "user_id")
    return messages.join(mine, "conv_id")


def chunk_lookup(ranked: DataFrame, chunks: DataFrame, bound: int, target: Column) -> DataFrame:
    """Ranked rows with stored metadata, ``is_target``, and per query whether the target was found."""
    out = lookup(ranked, chunks, ["chunk_id"], bound).withColumn("is_target", target)
    return out.withColumn("found", F.max("is_target").over(W.partitionBy("query_id")))
