"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets.

A word's letters form a binary vector: letter c is there for the k-th time or not. One inserted, deleted or replaced letter changes at
most two of its entries. The entries are dealt over ``PARTS`` parts by hash; vectors that differ in at most two entries agree in some
``PARTS - 2`` parts, so words that are near share the signature of one such choice. A signature also holds the length of the shorter
word, and its first or its last half, one of which an edit leaves as it is. Signatures are joined for equality, what meets is verified.
All is done with DataFrame functions; the words of all rows are counted before anything is joined, so how often a word occurs costs nothing.

Defined cases: a null text has no words; a null key is the empty string where the key is hashed; rows with equal keys or texts count
each; ties between near words of equal count go to the smaller by code points; an empty table gives an empty result; texts are read
whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.session import stored
from statuta.unfold import unfold

PARTS = 4
DIFFERENCE = 2
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
SHORTEST = 5
LEAST = 3
DROP = 97
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: The polynomial of crc32, for the SQL twin.
_POLYNOMIAL = 0xEDB88320
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP) -> DataFrame:
    """(word): the lower-cased runs of letters of every text, one row each.

    Where ``drop`` divides the crc32 of ``<key>:<run>``, the letter at that crc32 modulo the length is left out.
    """
    lower = F.translate(F.col(text).cast("string"), _UPPER, _UPPER.lower())
    runs = unfold(docs, [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_of")], F.regexp_extract_all(lower, F.lit(LETTERS), 0), "run")
    hashed = F.crc32(F.concat_ws(":", "_of", "run").cast("binary"))
    at = F.col("_crc") % F.length("run")
    shorter = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return runs.withColumn("_crc", hashed).select(F.when(F.col("_crc") % drop == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(found: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the distinct words of at least ``shortest`` letters and ``least`` occurrences."""
    return found.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def letters(word: str = "word", alphabet: str = ALPHABET) -> Column:
    """The letters of a word with their counts, in the order of the alphabet; a word of any length is read in place."""
    there = F.filter(F.array(*map(F.lit, alphabet)), lambda c: F.contains(F.col(word), c))
    return F.transform(there, lambda c: F.struct(c.alias("c"), (F.length(word) - F.length(F.replace(F.col(word), c, F.lit("")))).alias("n")))


def parts(counts: Column | str, n: int = PARTS) -> list[Column]:
    """The letter vector in ``n`` parts.

    The k-th entry of a letter falls to part (hash of the letter + k) mod n, so how many of its entries a part has says which ones.
    """
    counts = F.col(counts) if isinstance(counts, str) else counts

    def part(k: int) -> Column:
        # entries r, r + n, r + 2n, ... up to the count, with r from 1 to n
        first = lambda e: n - F.pmod(F.xxhash64(e["c"]) - k, F.lit(n))
        own = F.transform(counts, lambda e: F.struct(e["c"], F.floor((e["n"] - first(e) + n) / n).alias("m")))
        return F.array_join(F.transform(F.filter(own, lambda e: e["m"] > 0), lambda e: F.concat(e["c"], e["m"].cast("string"))), "")

    return [part(k) for k in range(n)]


def signatures(counts: DataFrame, n: int = PARTS, difference: int = DIFFERENCE) -> DataFrame:
    """(word, n, longer, signature): for each choice of parts, length of the shorter word and half of the word.

    ``longer`` marks the signatures of a word as the longer one of a pair.
    """
    named = [f"_part{k}" for k in range(n)]
    split = counts.withColumn("_letters", letters()).withColumns(dict(zip(named, parts("_letters", n))))

    def all_of(longer: bool) -> list[Column]:
        size = F.length("word") - int(longer)
        half = F.floor(size / 2).cast("int")
        ends = {"p": F.substring("word", F.lit(1), half), "s": F.substring("word", F.length("word") - (size - half) + 1, size - half)}
        return [
            F.struct(F.lit(longer).alias("longer"), F.xxhash64(size, F.lit(f"{side}{chosen}"), end, *[named[k] for k in chosen]).alias("signature"))
            for side, end in ends.items() for chosen in combinations(range(n), n - difference)
        ]

    return split.select("word", "n", F.explode(F.array(*all_of(False), *all_of(True))).alias("s")).select("word", "n", "s.*")


def near(counts: DataFrame, n: int = PARTS, difference: int = DIFFERENCE) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words exactly one edit apart."""
    signed = signatures(counts, n, difference)
    short = signed.filter(~F.col("longer")).select("signature", "word", "n")
    other = signed.select("signature", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer")
    # words of one length meet once, in the order of their letters
    met = short.join(other, "signature").filter(F.col("longer") | (F.col("word") < F.col("other")))
    pairs = met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").dropDuplicates(["word", "other"])
    names = pairs.columns
    both = [F.struct(*[F.col(c).alias(name) for c, name in zip(order, names)]) for order in (names, names[2:] + names[:2])]
    return pairs.select(F.explode(F.array(*both)).alias("p")).select("p.*")


def forms(counts: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, where that is ``factor`` times the word's own at least."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("b"))
    joined = counts.join(best, "word", "left").withColumn("_n", -F.col("b.less"))
    enough = F.col("_n") >= factor * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.other")).alias("form"), F.when(enough, F.col("_n")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last one when forms are followed.

    Each step joins the table with itself and doubles the distance. A form counts twice its word at least, so 6 steps reach further
    than any 64-bit count; they stop earlier when no end has a form of its own.
    """
    linked = stored(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    for _ in range(6):
        onward = linked.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = linked.join(onward, "root", "left")
        if step.filter(F.col("_next").isNotNull()).isEmpty():
            break
        linked = stored(step.select("word", F.coalesce("_next", "root").alias("root")), "forms")
    return linked


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the table."""
    counts = stored(counted(words(docs, key, text)), "words")
    found = stored(forms(counts, near(counts)), "spelling")
    out = found.join(roots(found), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def neighbours(word: str, alphabet: Iterable[str]) -> set[str]:
    """All strings exactly one edit from ``word`` (for tests and small look-ups)."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    edits = [{a + b[1:] for a, b in cuts if b}, {a + c + b for a, b in cuts for c in alphabet}, {a + c + b[1:] for a, b in cuts if b for c in alphabet}]
    return reduce(set.union, edits) - {word}


#: The same rows by deletions: words are near if they agree without their i-th letters, or if one is the other without a letter.
SQL = f"""WITH RECURSIVE bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT k, run, count(*) AS n FROM runs GROUP BY ALL),
codes AS (SELECT run, n, flatten(list_transform(string_split(k || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM each),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b::BIGINT[]), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) AS h FROM codes, crc),
cut AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut GROUP BY word HAVING length(word) >= {SHORTEST} AND sum(n) >= {LEAST}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) t(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
follow AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT follow.word, f.form FROM follow JOIN f ON f.word = follow.root WHERE f.form IS NOT NULL),
ends AS (SELECT follow.word, follow.root FROM follow JOIN f ON f.word = follow.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word"""
