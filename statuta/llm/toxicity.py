"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Tokens are lower-cased words and their beginnings of 4, 5 and 6 bytes. A token's log-odds of lying in a toxic document have a
Dirichlet prior: its centre is the estimate of the next shorter beginning (for the shortest, the rate of all labelled documents),
its weight follows the token's document frequency in the whole corpus. A word takes the log-odds of its longest known token, less
a drift that makes ordinary text score below zero, where that is positive. Every other word takes the constant ``NEUTRAL``: a score of
zero or less is clamped to it, and a word of a family without a positive token has no score of its own. So clean evidence is not summed,
an ordinary word costs 0.25 where its log-odds of 0 less the drift would be -1.5, segments bridge longer clean stretches (six clean words
cost what one would), and the scan passes over all but a few words. One linear scan finds all maximal segments of a text. Their scores, against the
length of the text, become extreme-value scores (Karlin and Altschul); the sum over significant segments is mapped to a
probability by a logistic curve fitted on labelled documents that the log-odds were not learned from.

Defined cases: null and empty texts have no segment and get the lowest score; without labelled rows of both kinds every score is
the rate of label 1 in the sample (0.0 without any); ties between segments change nothing; texts are read whole; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm import labelled
from statuta.llm.words import WORD_SEPARATORS, lowered, pieces, slices
from statuta.session import stored

#: Labelled rows to learn from at most; one in CALIBRATION of them only fits the curve.
SAMPLE = 12_000
CALIBRATION = 4
LEVELS = (4, 5, 6, None)
#: A token has to occur in so many toxic documents of the sample.
LEAST = 2
#: Weight of a prior: at least, and as a share of a token's expected labelled documents.
PRIOR, PRIOR_SHARE = 8.0, 0.05
DRIFT = 1.5
NEUTRAL = -0.25
MAP_BITS = 20


def tokens(piece, text) -> list[np.ndarray]:
    """Hashes of each word's tokens, one array a level; a level's hashes differ from the other levels'."""
    found = [piece.words() if n is None else piece.prefixes(n) for n in LEVELS]
    return [h * np.uint64(2 * k + 3) for k, h in enumerate(found)]


def maximal_segments(at: np.ndarray, score: np.ndarray, neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal segments (first word, last word, score), in order.

    ``at``: the words whose score is not ``neutral``. Every word is passed once: a positive word is put behind the latest candidate that
    starts from a lower running sum, and takes in what lies between when it ends higher than that one.
    """
    rows: list[list] = []  # first, last, sum before, sum at the end
    total, before = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist()):
        total += neutral * (i - before - 1)
        left, total, before = total, total + s, i
        if s <= 0:
            continue
        new = [i, i, left, total]
        while True:
            j = len(rows) - 1
            while j >= 0 and rows[j][2] >= new[2]:
                j = rows[j][4]
            if j < 0 or rows[j][3] >= new[3]:
                rows.append([*new, j])
                break
            new = [rows[j][0], new[1], rows[j][2], new[3]]
            del rows[j:]
    return [(a, b, end - start) for a, b, start, end, _ in rows]


@dataclass
class Model:
    #: For each level the hashes, sorted, and their scores.
    hashes: list = field(default_factory=lambda: [np.zeros(0, np.uint64)] * len(LEVELS))
    scores: list = field(default_factory=lambda: [np.zeros(0)] * len(LEVELS))
    map: np.ndarray | None = None
    decay: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = -np.inf

    def word_scores(self, piece, text) -> tuple[np.ndarray, np.ndarray]:
        """Words with a score of their own, and their scores."""
        if self.map is None or not len(text):
            return np.zeros(0, np.int64), np.zeros(0)
        first = piece.prefixes(LEVELS[0]) * np.uint64(3)
        at = np.flatnonzero(self.map[(first >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        score = np.full(len(at), np.nan)
        for k, n in enumerate(LEVELS):
            if not len(self.hashes[k]):
                continue
            ends = piece.ends[at] if n is None else np.minimum(piece.starts[at] + n, piece.ends[at])
            h = piece.hashes(piece.starts[at], ends) * np.uint64(2 * k + 3)
            place = np.minimum(np.searchsorted(self.hashes[k], h), len(self.hashes[k]) - 1)
            score = np.where(self.hashes[k][place] == h, self.scores[k][place], score)
        known = ~np.isnan(score)
        return at[known], score[known]

    def segments(self, texts: pa.Array) -> tuple[list[list], np.ndarray]:
        """Each text's maximal segments by word position, and the number of its words."""
        at: list[list] = [[] for _ in range(len(texts))]
        words = np.zeros(len(texts), np.int64)
        for piece, text in pieces(lowered(texts), WORD_SEPARATORS):
            here, score = self.word_scores(piece, text)
            for i in np.unique(text[here]):
                own = text[here] == i
                start = np.searchsorted(text, i)
                at[i].append((here[own] - start + words[i], score[own]))
            words += np.bincount(text, minlength=len(texts))
        return [maximal_segments(*(np.concatenate(x) for x in zip(*a))) if a else [] for a in at], words

    def statistic(self, texts: pa.Array) -> np.ndarray:
        """Sum over significant segments of the extreme-value score; for a text without any, that of the best one."""
        found, words = self.segments(texts)
        out = np.empty(len(texts))
        for i, segments in enumerate(found):
            chance = np.log(self.k * max(2, words[i]))
            over = sorted((self.decay * s - chance for _, _, s in segments), reverse=True)
            out[i] = over[0] + sum(x for x in over[1:] if x > 0) if over else -chance
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.slope == 0:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.statistic(texts) + self.offset, -50, 50)))


def _sample_counts(rows: DataFrame) -> DataFrame:
    """(level, token, parent, toxic, clean): documents of the sample that hold each token."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy()
                seen: list[list] = [[] for _ in LEVELS]
                for piece, text in pieces(lowered(part.column("text")), WORD_SEPARATORS):
                    found = tokens(piece, text)
                    for k, h in enumerate(found):
                        seen[k].append((h, found[k - 1] if k else np.zeros(len(h), np.uint64), text))
                for k, parts in enumerate(seen):
                    if not parts:
                        continue
                    h, parent, text = (np.concatenate(x) for x in zip(*parts))
                    order = np.lexsort((text, h))
                    h, parent, text = h[order], parent[order], text[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                    h, parent, one = h[new], parent[new], label[text[new]]
                    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                    total, toxic = np.diff(np.append(starts, len(h))), np.add.reduceat(one, starts) if len(h) else starts
                    yield pa.record_batch(
                        [pa.array(np.full(len(starts), k, np.int32)), pa.array(h[starts].view(np.int64)), pa.array(parent[starts].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((total - toxic).astype(np.int64))],
                        ["level", "token", "parent", "toxic", "clean"],
                    )

    counts = rows.mapInArrow(run, "level int, token long, parent long, toxic long, clean long")
    return counts.groupBy("level", "token", "parent").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def document_frequencies(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each of the given tokens (sorted hashes), counted over all documents."""

    def run(batches):
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                seen = []
                for piece, text in pieces(lowered(part.column("text")), WORD_SEPARATORS):
                    for h in tokens(piece, text):
                        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        hit = wanted[place] == h
                        seen.append(text[hit] * len(wanted) + place[hit])
                if seen:
                    counts += np.bincount(np.unique(np.concatenate(seen)) % len(wanted), minlength=len(wanted))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows whose key's crc32 modulo ``parts`` is not ``held_out``; corpus frequencies cover all documents."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = labelled.labelled(labels, label, sample, parts, held_out).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0)
    chosen = chosen.sparkSession.createDataFrame(chosen.toArrow().to_pandas(), chosen.schema)  # bounded; chosen once
    # one row a sampled key, however many rows have it; written once, as it is read three times
    rows = stored(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "curve").agg(F.min("text").alias("text")), "sample")
    sizes = {(r["curve"], r["label"]): r["n"] for r in rows.groupBy("curve", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    share = sum(n for (_, y), n in sizes.items() if y) / max(1, sum(sizes.values()))
    flat = Model(offset=float(np.log(share) - np.log1p(-share)) if 0 < share < 1 else (np.inf if share else -np.inf))
    if not toxic or not clean:
        return flat
    found = _sample_counts(rows.filter(~F.col("curve")).select("label", "text")).filter(F.col("toxic") >= LEAST).toArrow().to_pandas()
    if not len(found):
        return flat
    found["token"], found["parent"] = found.token.to_numpy().view(np.uint64), found.parent.to_numpy().view(np.uint64)
    found = found.sort_values(["level", "token"]).reset_index(drop=True)
    wanted = np.unique(found.token.to_numpy())
    total = docs.count()
    everywhere = document_frequencies(docs, wanted)[np.searchsorted(wanted, found.token.to_numpy())]
    model = _log_odds(found, everywhere * ((toxic + clean) / max(1, total)), toxic / (toxic + clean))
    return _calibrated(model, rows.filter("curve").select("label", "text"), flat)


def _log_odds(found, expected: np.ndarray, share: float) -> Model:
    """Scores level by level; kept are the tokens of words that some token makes positive."""
    base = np.log(share / (1 - share))
    known: dict = {}
    rate = np.empty(len(found))
    weight = PRIOR + PRIOR_SHARE * expected
    for i, (token, parent, toxic, clean) in enumerate(zip(found.token, found.parent, found.toxic, found.clean)):
        rate[i] = known[token] = (toxic + weight[i] * known.get(parent, share)) / (toxic + clean + weight[i])
    score = np.log(rate / (1 - rate)) - base - DRIFT
    # a word with no positive token on any level scores NEUTRAL; its family has to be known where one is positive
    family: dict = {}
    for token, parent in zip(found.token, found.parent):
        family[token] = family.get(parent, token)
    roots = {family[t] for t, s in zip(found.token, score) if s > 0}
    own = np.array([family[t] in roots for t in found.token], bool)
    model = Model(map=np.zeros(1 << MAP_BITS, bool))
    for k in range(len(LEVELS)):
        rows = own & (found.level.to_numpy() == k)
        model.hashes[k], model.scores[k] = found.token.to_numpy()[rows], np.where(score[rows] > 0, score[rows], NEUTRAL)
    model.map[(model.hashes[0] >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    return model


def _calibrated(model: Model, rows: DataFrame, flat: Model) -> Model:
    """Decay from the token scores of clean documents, then the curve from extreme-value scores of both kinds."""

    def scores(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy()
                sums: dict[float, int] = {}
                for piece, text in pieces(lowered(part.column("text")), WORD_SEPARATORS):
                    at, score = model.word_scores(piece, text)
                    score = score[label[text[at]] == 0]
                    sums[NEUTRAL] = sums.get(NEUTRAL, 0) + int((label[text] == 0).sum()) - len(score)
                    for s, n in zip(*np.unique(np.round(score, 1), return_counts=True)):
                        sums[float(s)] = sums.get(float(s), 0) + int(n)
                yield pa.record_batch([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())], ["score", "n"])

    table = rows.mapInArrow(scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    value, n = np.append(table.score, max(s.max(initial=1.0) for s in model.scores)), np.append(table.n, 1).astype(float)
    low, high = 1e-3, 3.0
    for _ in range(60):  # the positive root of mean(exp(decay * score)) = 1
        model.decay = (low + high) / 2
        low, high = (low, model.decay) if np.average(np.exp(model.decay * value), weights=n) > 1 else (model.decay, high)

    def statistics(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("label"), pa.array(model.statistic(part.column("text")))], ["label", "x"])

    table = rows.mapInArrow(statistics, "label int, x double").toArrow().to_pandas()
    x, y = table.x.to_numpy(), table.label.to_numpy()
    if not 0 < y.sum() < len(y):
        return flat
    # logistic curve on the clipped statistic, with one pseudo-row of either label at the middle (Newton's method)
    centre, scale = (x[y == 1].mean() + x[y == 0].mean()) / 2, max(1e-6, x.std())
    z, t, w = np.append((x - centre) / scale, [0, 0]), np.append(y, [0, 1]), np.ones(len(x) + 2)
    z = np.clip(z, -3, 3)
    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-(a * z + b)))
        v = w * p * (1 - p) + 1e-9
        g = np.array([(w * (t - p) * z).sum() - 0.01 * a, (w * (t - p)).sum()])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
    model.slope, model.offset = max(a, 1e-3) / scale, b - max(a, 1e-3) * centre / scale
    return model


THRESHOLD = 0.5


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = labelled.scored(docs, fit(docs, labels).score)
    return out.select(
        "doc_id",
        F.coalesce(labelled.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, score) of every significant passage; a score is its extreme-value score, above zero."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, out = part.column("doc_id").to_pylist(), []
                for i, (segments, words) in enumerate(zip(*model.segments(part.column("text")))):
                    chance = np.log(model.k * max(2, words))
                    out += [(ids[i], a, b, model.decay * s - chance) for a, b, s in segments if model.decay * s > chance]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "first_word", "last_word", "score"), x)) for x in out], schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first_word long, last_word long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = fit(docs, labels)
    return labelled.kept(docs, lambda texts: model.score(texts) < threshold)
