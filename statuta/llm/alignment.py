"""Alignment of two tokenizers over whole texts: which tokens of one overlap which of the other, and how often.

Tokenizer A is a byte-level one of ``tokenizers``, B one of ``sentencepiece``. Both work on a space and the text. The spans that the
libraries give (character offsets of A, piece spans of B) are coarse cuts; where they stop inside a character, or put several tokens
on one, the decoded bytes of the tokens give the exact ends. Byte offsets where tokens of both end cut the text into groups.

Neither tokenizer joins what a space after a visible character parts, nor (checked for B) a line feed and what follows it, or a letter
and a mark after it. So a text is aligned unit by unit, new units are put together again to runs for the tokenizers, and a task remembers
units within ``REMEMBERED`` bytes. Each row keeps its distinct links with their numbers;
counts of links over the corpus come from an aggregation, and go back to the rows by a join: a broadcast one within ``PAIRS`` counted
links, else a shuffled, salted one.

Defined cases: a text that is null, empty or not given back byte for byte by both tokenizers has no tokens, zeros and '' for groups;
strings of special tokens are plain text; rows with equal keys or texts count one by one; a null key is a key; an empty table gives an
empty result; a text of any length is aligned whole; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.joins import sized_join
from statuta.llm.words import slices
from statuta.session import stored

SPACE = "▁"
REMEMBERED = 256 << 20
#: So many units at most go to the tokenizers as one run.
RUN = 256
PAIRS = 1_000_000
#: A link's code is A's id times this plus B's id.
_B = 1 << 15
#: Where a text is cut: before a space run that follows a visible character.
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"\s ")
#: Where what lies between is cut further: after a single line feed between visible characters, and between a letter and a mark.
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
_SUB = re.compile(rf"(?<=\S\n)(?=\S)|(?<=[{_LATIN}])(?=[{_MARKS}])")


class Aligner:
    _made: dict = {}

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in byte for c in entry):
                self.a_bytes[i] = bytes(byte[c] for c in entry)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes((int(x[3:5], 16),)) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        beyond = re.compile(f"[^{SPACE}]{SPACE}|\n|[{_LATIN}][{_MARKS}]")
        if len(names) > _B or any(beyond.search(x) for x in names) or not self.b.is_byte(self.b.encode("\n")[-1]):
            raise ValueError(f"{b}: pieces that hold a line feed, go on past a space, or join a letter to a mark, are not covered")
        self.b_space = self.b.encode("\na ")[-1]
        self.b_lead = len(self.b.encode("\n"))
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them
        self.shown = [f"{i}{after}" for i in range(max(len(names), len(self.a_bytes))) for after in (",", "|", ";", "")]
        self._words: dict[str, tuple | None] = {}
        self._units: dict[str, tuple | None] = {}
        # what was remembered before, of which words that come again are taken over
        self._before: tuple[dict, dict] = {}, {}
        self._held = 0

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        """One a worker process."""
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def _learn(self, units: list[str], run: int = RUN) -> None:
        """Alignments of new units, all at once: their bytes lie one after another in both tokenizers."""
        # in plain ASCII the tokens' bytes alone are exact; the libraries' spans are asked for where characters have several bytes
        kinds = [[], [], [], []]
        for u in units:
            kinds[2 * (not u.isascii()) + (u[0] != " " or u[-1].isspace())].append(u)
        # units from a space to a visible character follow one another as in a text, others are given alone
        runs = [["".join(own[at : at + size]) for at in range(0, len(own), size)] for own, size in zip(kinds, (run, 1, run, 1))]
        plain, odd, units = runs[0] + runs[1], runs[2] + runs[3], list(chain(*kinds))
        # B puts a space in front itself; a run without one follows what nothing is joined to, as a line feed
        for_b = [u[1:] if u[0] == " " else "\n" + u for u in chain(plain, odd)]
        lead, space = self.b_lead, [self.b_space]
        a_ids = [e.ids for e in self.a.encode_batch_fast(plain, add_special_tokens=False)]
        b_ids = [(ids or space) if u[0] == " " else ids[lead:] for u, ids in zip(plain, self.b.encode(for_b[: len(plain)], num_threads=1))]
        raw = [u.encode() for u in chain(plain, odd)]
        base = np.cumsum([0] + [len(x) for x in raw])
        a_ends, b_ends = [], []
        found = self.a.encode_batch(odd, add_special_tokens=False)
        protos = self.b.encode(for_b[len(plain) :], return_type="proto", num_threads=1)
        for unit, start, one, proto in zip(odd, base[len(plain) :].tolist(), found, protos):
            upto = list(accumulate((len(c.encode()) for c in unit), initial=start))
            a_ids.append(one.ids)
            a_ends.append([upto[end] for _, end in one.offsets])
            pieces = proto.pieces[0 if unit[0] == " " else lead :]
            shift = start + (1 if unit[0] == " " else -1)
            b_ids.append([p.id for p in pieces])
            b_ends.append([shift + p.end for p in pieces])
        whole, sides = b"".join(raw), ((a_ids, self.a_bytes), (b_ids, self.b_bytes))
        made = None
        if all(b"".join(map(of.__getitem__, chain.from_iterable(ids))) == whole for ids, of in sides):
            a, spans_a, b, spans_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, a_ends, b_ids, b_ends))
            ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
            made = aligned(a, refined(spans_a, self.a_size[a]), b, refined(spans_b, self.b_size[b]), ends)
        if made is None and run > 1:
            return self._learn(units, 1)
        if made is None:
            # some unit is not given back: told apart one by one
            bad = [any(b"".join(map(of.__getitem__, ids[k])) != data for ids, of in sides) for k, data in enumerate(raw)]
            self._units.update((u, None) for u, no in zip(units, bad) if no)
            good = [u for u, no in zip(units, bad) if not no]
            return self._learn(good) if good else None
        codes, links, shown, n_a, n_b, groups = made
        parts, data = list(map(self.shown.__getitem__, shown.tolist())), codes.tobytes()
        at = t = 0
        for unit, x, y, n, g in zip(units, n_a.tolist(), n_b.tolist(), (4 * links).tolist(), groups.tolist()):
            self._units[unit] = ("".join(parts[t : t + x + y]), x, y, g, data[at : at + n])
            at, t = at + n, t + x + y
        self._held += 500 * len(units) + 8 * len(data)

    def _join(self, words: list[str]) -> None:
        """New words, from the units they are made of."""
        split = [_SUB.split(" " + word) for word in words]
        new = set().union(*split).difference(self._units)
        again = new & self._before[1].keys()
        self._units.update((u, self._before[1][u]) for u in again)
        self._held += 600 * len(again)
        new = list(new - again)
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        get = self._units.__getitem__
        for word, units in zip(words, split):
            self._words[word] = joined([get(u) for u in units]) if len(units) > 1 else get(units[0])
        self._held += sum(map(len, words)) + 500 * len(words)

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each text the groups as text, numbers of tokens of A and B, groups and links, and the codes of all links as bytes."""
        # very many small tuples are made and no cycles: the collector would walk all that is remembered again and again
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._align(texts)
        finally:
            if collecting:
                gc.enable()

    def _align(self, texts: list[str]) -> list[tuple | None]:
        split = []
        for text in texts:
            if _SPACES.search(" " + text):
                split.append([w[1:] for w in _CUT.split(" " + text)])
            else:
                split.append(text.split(" ") if text else [])
        if self._held > REMEMBERED // 2:
            self._before, self._words, self._units, self._held = (self._words, self._units), {}, {}, 0
        new = set().union(*split).difference(self._words)
        again = new & self._before[0].keys()
        self._words.update((w, self._before[0][w]) for w in again)
        self._held += 600 * len(again)
        self._join(list(new - again))
        get = self._words.__getitem__
        return [joined(list(map(get, own))) if own else None for own in split]


def joined(parts: list[tuple | None]) -> tuple | None:
    """One alignment of those of neighbouring parts."""
    if None in parts:
        return None
    shown, n_a, n_b, n_groups, codes = zip(*parts)
    return ";".join(shown), sum(n_a), sum(n_b), sum(n_groups), b"".join(codes)


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end that follow one another; ``coarse`` are the library's, of the last tokens.

    A coarse end holds where it is as far from the one before as its token is long; else, inside characters and at trimmed space, the
    token's decoded bytes decide.
    """
    ends = np.cumsum(sizes)
    last = len(ends) - len(coarse)
    ends[last:] = np.where(coarse - (ends - sizes)[last:] == sizes[last:], coarse, ends[last:])
    return ends


def aligned(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, unit_ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Links and groups of units that lie one after another, from where the tokens of both end; None if a token goes on past a unit.

    Codes of the links, how many each unit has, the tokens in the order of the groups as id * 4 + what follows (comma, bar, semicolon,
    nothing), how many of these of either and how many groups each unit has.
    """
    # between two neighbouring ends of either lies one token of each
    ends = np.union1d(a_ends, b_ends)
    codes = (a[np.searchsorted(a_ends, ends)] * _B + b[np.searchsorted(b_ends, ends)]).astype(np.int32)
    per = lambda at: np.diff(np.searchsorted(at, unit_ends, "right"), prepend=0)
    common = np.intersect1d(a_ends, b_ends)
    if not np.isin(unit_ends, common).all():
        return None
    of_a, of_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    count_a, count_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
    shown = np.empty(len(a) + len(b), np.int64)
    after_b = np.where(np.isin(common, unit_ends), 3, 2)
    shown[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[of_a]] = a * 4 + (a_ends == common[of_a])
    shown[np.arange(len(b)) + np.cumsum(count_a)[of_b]] = b * 4 + np.where(b_ends == common[of_b], after_b[of_b], 0)
    return codes, per(ends), shown, per(a_ends), per(b_ends), per(common)


_FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def links(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """A row each: key, numbers of tokens, groups and links, the groups' hash, the distinct links (``codes``) and how often each occurs
    (``times``); with ``groups`` also the groups as text."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"] + ["groups"] * groups

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = Aligner.of(a, b).align([x or "" for x in part.column("text").to_pylist()])
                stats = [(x[1], x[2], x[3], len(x[4]) // 4, hashlib.sha256(x[0].encode()).hexdigest()) if x else (0, 0, 0, 0, "") for x in found]
                codes = np.frombuffer(b"".join(x[4] for x in found if x), np.int32)
                of = np.repeat(np.arange(len(found)), [s[3] for s in stats])
                both, times = np.unique(of << 31 | codes, return_counts=True)
                cuts = pa.array(np.searchsorted(both, np.arange(len(found) + 1) << 31), pa.int32())
                numbers = [pa.array(x) for x in zip(*stats)]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (both & (2**31 - 1), times)]
                shown = [pa.array([x[0] if x else "" for x in found])] * groups
                yield pa.record_batch([part.column("row"), part.column("key"), *numbers, *lists, *shown], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"row long, key {kind}, {_FOUND}, codes array<int>, times array<int>" + ", groups string" * groups
    return rows.mapInArrow(run, schema)


def link_counts(found: DataFrame) -> DataFrame:
    """(code, n, best): in how many rows each link occurs, and whether none of its A id occurs in more."""
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy(F.floor(F.col("code") / _B)))
    return counts.select("code", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    found = stored(links(docs, a, b, key, text), "links")
    counts = stored(link_counts(found), "pairs")
    keep = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = found.filter(F.col("n_links") > 0).select(*keep, F.explode(F.arrays_zip("codes", "times")).alias("l")).select(*keep, "l.codes", "l.times")
    met = sized_join(each.withColumnRenamed("codes", "code"), counts, ["code"], ["row"], measure=counts, rows=pairs)
    summed = met.groupBy(*keep).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    bare = found.filter(F.col("n_links") == 0).select(*keep, zero.alias("n_best"), zero.alias("count_sum"))
    return summed.unionByName(bare).select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
