"""Keyword columns: extraction, overlap, coverage, query class, questions asked back."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import any_of, naming, words


@dataclass(frozen=True)
class Lexicon:
    """The word lists of one language; the defaults are the Vietnamese legal ones."""

    compounds: list = field(default_factory=lambda: V.LEGAL_COMPOUNDS)
    stopwords: list = field(default_factory=lambda: V.STOPWORDS)
    query_types: list = field(default_factory=lambda: V.QUERY_TYPES)
    clarify_patterns: list = field(default_factory=lambda: V.CLARIFY_PATTERNS)
    clarify_triggers: list = field(default_factory=lambda: V.CLARIFY_TRIGGERS)
    missing_info: list = field(default_factory=lambda: V.MISSING_INFO)
    location_words: list = field(default_factory=lambda: V.LOCATION_WORDS)
    time_words: list = field(default_factory=lambda: V.TIME_WORDS)
    subject_words: list = field(default_factory=lambda: V.SUBJECT_WORDS)
    fallback_stopwords: list = field(default_factory=lambda: V.FALLBACK_STOPWORDS)
    generic_questions: list = field(default_factory=lambda: V.GENERIC_QUESTIONS)


VIETNAMESE = Lexicon()


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_runs(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def keywords(text: Column, lexicon: Lexicon = VIETNAMESE, min_length: int = 2) -> Column:
    """Compounds present, then single words that are no stopword and in no found compound."""
    low = F.lower(text)
    found = naming(low, lambda t: F.filter(strings(lexicon.compounds), lambda c: F.contains(t, c)))
    inside = F.flatten(F.transform(found, lambda c: F.split(c, " ")))
    single = F.filter(F.array_distinct(word_runs(low)), lambda w: F.length(w) >= min_length)
    single = F.array_except(single, strings(lexicon.stopwords))
    return F.concat(found, F.array_except(F.array_except(single, inside), found))


def overlap(query_words: Column, context: Column) -> Column:
    """Share of query keywords found in the context; 1 when there is none to look for.

    A keyword of the context is always a substring of its lower-case text, so the
    substring test alone decides.
    """
    n = F.size(query_words)
    hits = F.size(naming(F.lower(context), lambda low: F.filter(query_words, lambda w: F.contains(low, w))))
    return F.when(n == 0, F.lit(1.0)).otherwise(hits / n)


def coverage(query_words: Column, texts: Column) -> Column:
    """struct(coverage to four places, found, missing) of keywords in the joined texts."""
    n = F.size(query_words)
    found = naming(F.lower(texts), lambda low: F.filter(query_words, lambda w: F.contains(low, w)))
    return naming(
        found,
        lambda f: F.struct(
            F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.size(f) / n, 4)).alias("coverage"),
            f.alias("found"),
            F.array_except(query_words, f).alias("missing"),
        ),
    )


def query_type(query: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    low = F.lower(query)
    hits = F.array_compact(
        F.array(*[F.when(any_of(low, marks), F.lit(name)) for name, marks in lexicon.query_types])
    )
    return F.when(F.size(hits) > 0, F.array_join(hits, ",")).otherwise(F.lit("general"))


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in cases], default)


def clarification(query: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    """The question to ask back for an unclear query, null when it is clear."""
    low = F.lower(query)
    few = F.size(words(query)) < 10
    cases = [(low.rlike(p), F.lit(q)) for p, q in lexicon.clarify_patterns]
    cases += [(F.contains(low, F.lit(t)) & few, F.lit(q)) for t, q in lexicon.clarify_triggers]
    return _first(cases, F.lit(None).cast("string"))


def missing_info(query: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    """struct(kind, question) of the information a query lacks; kind is null when nothing."""
    low = F.lower(query)
    kinds = [
        (any_of(low, triggers) & ~low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(q).alias("question")))
        for kind, triggers, q, pattern in lexicon.missing_info
        if pattern
    ]
    short = F.struct(F.lit("detail").alias("kind"), F.lit(V.DETAIL_QUESTION).alias("question"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("question"))
    return _first([*kinds, (F.size(words(query)) < 5, short)], none)


def gate_question(query: Column, missing: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    """The gate's question, chosen by the query's words and the keywords not covered."""
    low = F.lower(query)
    return (
        F.when(any_of(low, lexicon.location_words), F.lit(V.LOCATION_QUESTION))
        .when(any_of(low, lexicon.time_words), F.lit(V.TIME_QUESTION))
        .when(F.arrays_overlap(missing, strings(lexicon.subject_words)), F.lit(V.SUBJECT_QUESTION))
        .otherwise(F.lit(V.DETAIL_QUESTION))
    )


def generic_question(query: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    low = F.lower(query)
    return _first([(any_of(low, marks), F.lit(q)) for marks, q in lexicon.generic_questions], F.lit(V.GENERIC_DEFAULT))


def fallback_coverage(query: Column, texts: Column, lexicon: Lexicon = VIETNAMESE) -> Column:
    """Share of the query's distinct words found in the joined texts; 0 when it has none."""
    distinct = F.array_except(
        F.filter(F.array_distinct(word_runs(F.lower(query))), lambda w: F.length(w) > 1),
        strings(lexicon.fallback_stopwords),
    )
    row = F.struct(F.lower(texts).alias("low"), distinct.alias("w"))
    share = lambda r: F.size(F.filter(r["w"], lambda w: F.contains(r["low"], w))) / F.size(r["w"])
    return naming(row, lambda r: F.when(F.size(r["w"]) == 0, F.lit(0.0)).otherwise(share(r)))
