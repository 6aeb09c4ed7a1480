"""Benchmark decontamination: BM25 over an inverted index of the test items, evaluated by block-max WAND, then verified.

The test items are the indexed collection and every passage of every document is a query. An impact is a term's BM25 weight in an item as
a share of the item's score for itself, so one threshold means the same for all items. Postings are kept in blocks of a few items with
the greatest impact of each block. Passages are evaluated many at once: a passage whose terms' greatest impacts sum to less than the
threshold has no pivot and ends there; of the rest, only the blocks whose block maxima reach the threshold have their postings
scored. All items at or above the threshold are retrieved. Where the heaviest words that a passage can lack while it still holds enough
of the item's shingles would take an item below the threshold, its impacts are raised, so retrieval loses no passage that counts.

A retrieved item counts when the passage holds enough of its shingles of five words, wherever in the item they lie. The shares of the
shingles inside the question, and of those that reach into the answer, are reported and decide nothing: the answer is what follows the
last question mark, or else the last line, the last sentence, or the last third of the words, which is a guess.

Passages overlap by half and are long enough that every run of words up to 1.25 times the longest item lies in one.

An item of fewer than five words counts where the passage holds one run of all its words.

Defined cases: a null or empty text has no passage; a null item, and an item of fewer than ``shortest`` words, is not searched for; items with equal
texts are all reported; documents with equal rows are reported one by one; an empty benchmark leaves every document; texts are
read whole; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from statuta.llm.words import mix, slices, word_hashes
from statuta.session import stored

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved.
THRESHOLD = 0.6
#: Items a block of postings covers.
BLOCK = 4
#: Share of an item's shingles from which it counts.
OVERLAP = 0.8
SHINGLE = 5
#: Items, and bytes of their texts, that one pass over the documents looks for at most, about.
PASS_ITEMS, PASS_BYTES = 2000, 4 << 20
MAP_BITS = 20


def question_words(text: str, total: int) -> int:
    """How many of the item's words are the question's."""

    def words(part: str) -> int:
        return int(word_hashes(pa.array([part]))[1][1])

    for mark in (r"\?", r"\n", r"[.!:](?=\s)"):
        for found in reversed(list(re.finditer(mark, text))):
            before = words(text[: found.end()])
            if 0 < before < total:
                return before
    return total - max(1, total // 3)


def least_score(runs: np.ndarray, weight: np.ndarray) -> float:
    """No passage with ``OVERLAP`` of the runs scores less; ``weight``: of each word of the item, as a share of the item's score.

    A word is missing only where every run over it is, so no more words can be missing than runs: at worst the heaviest.
    """
    repeats = np.sort(np.unique(runs, return_counts=True)[1])[::-1]
    missing = len(repeats) - int(np.ceil(OVERLAP * len(repeats) - 1e-9))
    return 1.0 - float(np.sort(weight)[::-1][: repeats[:missing].sum()].sum()) - 1e-9


def joined(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out + words[i : i + len(out)] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1)
    return mix(out)


@dataclass
class Index:
    items: list
    terms: np.ndarray
    #: Term x block: greatest impacts.
    blocks: np.ndarray
    #: Postings by ``term number * items + item number``, and their impacts.
    postings: np.ndarray
    impacts: np.ndarray
    #: Of each item: shingles within the question, and shingles that reach into the answer.
    shingles: list[tuple[np.ndarray, np.ndarray]]
    #: Of each item: what its impacts add up to.
    raised: np.ndarray
    #: Of each item: words of its shingles.
    sizes: list[int]
    stride: int
    map: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str], frequency: dict[int, int], total: int, mean: float, shortest: int = SHINGLE) -> Index | None:
        words, cuts = word_hashes(pa.array(texts, pa.string()))
        use = [i for i in range(len(ids)) if cuts[i + 1] - cuts[i] >= max(1, shortest)]
        if not use:
            return None
        n, terms = len(use), np.unique(np.concatenate([words[cuts[i] : cuts[i + 1]] for i in use]))
        df = np.array([frequency[int(t)] for t in terms], float)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        blocks = np.zeros((len(terms), -(-n // BLOCK)), np.float32)
        keys, impacts, shingles, raised, sizes, longest = [], [], [], np.ones(n), [], 0
        for k, i in enumerate(use):
            own = words[cuts[i] : cuts[i + 1]]
            distinct, place, count = np.unique(own, return_inverse=True, return_counts=True)
            at = np.searchsorted(terms, distinct)
            weight = idf[at] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(own) / mean))
            weight /= weight.sum()
            size = min(SHINGLE, len(own))
            runs, asked = joined(own, size), question_words(texts[i], len(own))
            raised[k] = THRESHOLD / max(1e-9, least_score(runs, (weight / count)[place]))
            if size == SHINGLE:  # a short item has to be there with all its words
                raised[k] = max(1.0, raised[k])
            sizes.append(size)
            weight *= raised[k]
            keys.append(at * n + k)
            impacts.append(weight)
            blocks[at, k // BLOCK] = np.maximum(blocks[at, k // BLOCK], weight.astype(np.float32) * np.float32(1 + 1e-6))
            inside = np.arange(len(runs)) + size <= asked
            shingles.append((np.unique(runs[inside]), np.unique(runs[~inside])))
            longest = max(longest, len(own))
        keys, impacts = np.concatenate(keys), np.concatenate(impacts)
        order = np.argsort(keys)
        seen = np.zeros(1 << MAP_BITS, bool)
        seen[(terms >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        return cls([ids[i] for i in use], terms, blocks, keys[order], impacts[order], shingles, raised, sizes, -(-5 * longest // 4), seen)

    def retrieve(self, words: np.ndarray, cuts: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, ...]:
        """(text, first word, item number, score) of all passages and items that reach the threshold."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        at = np.flatnonzero(self.map[(words >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        known = self.terms[term] == words[at]
        at, term = at[known], term[known]
        if not len(at):
            return none
        text = np.searchsorted(cuts, at, "right") - 1
        # a passage is two strides long: a word in stride j lies in passages j - 1 and j
        strides = np.maximum(1, -(-np.diff(cuts) // self.stride))
        base = np.concatenate([[0], np.cumsum(strides)])
        last = base[text] + (at - cuts[text]) // self.stride
        also = last > base[text]
        key = np.unique(np.concatenate([last, last[also] - 1]) * len(self.terms) + np.concatenate([term, term[also]]))
        passage, term = key // len(self.terms), key % len(self.terms)
        pivot = np.bincount(passage, self.blocks.max(1)[term], base[-1]) >= threshold
        use = pivot[passage]
        passage, term = passage[use], term[use]
        if not len(passage):
            return none
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        ends = np.append(starts[1:], len(passage))
        row, block = [], []
        for a in range(0, len(starts), 4096):  # bounds of some thousand passages at a time
            b = min(a + 4096, len(starts))
            bound = np.add.reduceat(self.blocks[term[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], 0)
            r, k = np.nonzero(bound >= threshold * (1 - 1e-5))
            row.append(r + a)
            block.append(k)
        row, block = np.concatenate(row), np.concatenate(block)
        if not len(row):
            return none
        # postings of the passage's terms in the blocks that are left
        n = len(self.items)
        size = ends[row] - starts[row]
        pair = np.repeat(np.arange(len(row)), size)
        own = term[np.repeat(starts[row], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]
        score = np.zeros((len(row), BLOCK))
        for k in range(BLOCK):
            item = block[pair] * BLOCK + k
            wanted = own * n + item
            place = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
            hit = (self.postings[place] == wanted) & (item < n)
            score[:, k] = np.bincount(pair[hit], self.impacts[place[hit]], len(row))
        r, k = np.nonzero(score >= threshold)
        found = passage[starts[row[r]]]
        of = np.searchsorted(base, found, "right") - 1
        return of, (found - base[of]) * self.stride, block[r] * BLOCK + k, score[r, k]

    def matches(self, texts: pa.Array) -> list[tuple]:
        """(text, item, score, question share, answer share, first word of the passage), the best passage of each text and item."""
        words, cuts = word_hashes(texts)
        best: dict = {}
        for text, first, item, score in zip(*(x.tolist() for x in self.retrieve(words, cuts))):
            inside = joined(words[cuts[text] + first : min(cuts[text] + first + 2 * self.stride, cuts[text + 1])], self.sizes[item])
            question, answer = self.shingles[item]
            asked, told = int(np.isin(question, inside).sum()), int(np.isin(answer, inside).sum())
            share_q = asked / len(question) if len(question) else 1.0
            share_a = told / len(answer) if len(answer) else 1.0
            # question and answer may have a shingle in common; the item has it once
            both = np.intersect1d(question, answer, True)
            held, size = asked + told - int(np.isin(both, inside).sum()), len(question) + len(answer) - len(both)
            if held >= OVERLAP * size - 1e-9:
                row = (held, score / float(self.raised[item]), -first, share_q, share_a)
                best[text, item] = max(best.get((text, item), row), row)
        return [(text, self.items[item], score, q, a, -first) for (text, item), (_, score, first, q, a) in sorted(best.items())]


def indexes(benchmark: DataFrame, shortest: int = SHINGLE) -> list[Index]:
    """Indexes of bounded size over all items of at least ``shortest`` words; term frequencies and lengths are those of all of these."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))

    def terms(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, cuts = word_hashes(part.column("text"))
                runs = [np.unique(words[a:b]) if b - a >= max(1, shortest) else words[:0] for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch(
                    [part.column("item_id"), pa.array([r.view(np.int64) for r in runs], pa.list_(pa.int64())), pa.array(np.diff(cuts)), pa.array([len(r) > 0 for r in runs])],
                    ["item_id", "terms", "words", "used"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    counted = stored(items.mapInArrow(terms, f"item_id {kind}, terms array<long>, words long, used boolean").filter("used"), "items")
    n, mean = counted.agg(F.count("*"), F.avg("words")).first()
    if not n:
        return []
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    passes = max(-(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    frequency = stored(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "frequency")
    out = []
    for i in range(passes):
        part = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i
        own = frequency.join(counted.filter(part).select(F.explode("terms").alias("term")).distinct(), "term").toArrow()
        rows = items.filter(part).orderBy("item_id", "text").toArrow()
        df = dict(zip(own["term"].to_numpy().view(np.uint64).tolist(), own["n"].to_pylist()))
        index = Index.of(rows["item_id"].to_pylist(), rows["text"].to_pylist(), df, n, mean, shortest)
        if index:
            out.append(index)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, shortest: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): every document and test item of at least ``shortest`` words that it holds.

    Keys keep their types.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = [df.schema[c].dataType for df, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"
    item = to_arrow_type(kinds[1])

    def scan(index: Index):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    text, *rest = list(zip(*index.matches(part.column("text")))) or [()] * 6
                    columns = [pa.array(c, k) for c, k in zip(rest, (item, pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
                    yield pa.record_batch([part.column("doc_id").take(pa.array(text, pa.int64())), *columns], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        return rows.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, shortest):
        out = out.unionByName(scan(index))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHINGLE) -> DataFrame:
    """The documents that hold no test item of at least ``shortest`` words, with all columns."""

    def scan(index: Index):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in index.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        return run

    for index in indexes(benchmark, shortest):
        docs = docs.mapInArrow(scan(index), docs.schema)
    return docs
