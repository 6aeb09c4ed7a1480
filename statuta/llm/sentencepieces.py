"""SentencePiece encoding and decoding of whole tables by vectorised merge rounds.

The words of many texts lie in one flat array of symbols. Each round finds the smallest pair rank of every word, merges all its
leftmost occurrences at once, and drops finished words, until no pair is left. Words of more than ``LONG`` characters, where one
smallest rank a round would be slow, take the same merges in the order of ranks over linked positions. Both give what one merge at
a time (best score first, then leftmost) gives: where a merge makes a pair of no larger rank than its own, the merges to its right wait.

A word is a run of spaces with what follows it up to the next space; no piece of the vocabulary may reach beyond (checked on loading,
else a text is one word). A task remembers words within ``REMEMBERED`` bytes. Ids are decoded by one gather over the bytes of all pieces.

Defined cases: a null text is an empty one, which has no ids but the end id, and decodes to an empty text; the strings of control
pieces inside a text are plain text; characters outside the vocabulary become byte pieces; U+2581 in a text is a space, as in the library;
ids of broken UTF-8 decode to U+FFFD a byte; rows with equal keys or texts are encoded one by one; a null key is a key; an empty table
gives an empty result; a text of any length is encoded whole; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.words import slices

SPACE = "▁"
LONG = 256
#: Bytes of words and their ids that a task remembers, about.
REMEMBERED = 48 << 20
_NONE = np.int32(2**31 - 1)
_SHIFT = 21

codecs.register_error("statuta.each", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A byte-pair model with byte fallback and no text rewriting but that of spaces."""

    _made: dict = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        if sp.encode("Ａ  a", out_type=str)[-1] != SPACE + "a" or sp.normalize("Ａ  a ") != f"{SPACE}Ａ{SPACE * 2}a{SPACE}":
            raise ValueError(f"{path}: only models that leave texts as they are, but for a space in front, are covered")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in own) or sum(map(sp.is_byte, range(n))) != 256:
            raise ValueError(f"{path}: only models with byte fallback and without unused pieces are covered")
        self.end = sp.eos_id()
        ids = {names[i]: i for i in own}
        self.cross = any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in own)

        # characters that only occur inside longer pieces take numbers from n on
        symbols = dict(ids)
        for name in list(ids):
            for c in name:
                symbols.setdefault(c, len(symbols) - len(ids) + n)
        unknown = (1 << _SHIFT) - 1
        self.char = np.full(0x110000, unknown, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.inside = n
        ranks = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in own}, reverse=True))}
        rows = sorted(
            (symbols[name[:k]] << _SHIFT | symbols[name[k:]], i, ranks[sp.get_score(i)])
            for name, i in ids.items() for k in range(1, len(name)) if name[:k] in symbols and name[k:] in symbols
        )
        self.keys, result, rank = (np.array(x, np.int64) for x in (zip(*rows) if rows else [[]] * 3))
        self.keys = np.append(self.keys, np.int64(2**62))
        self.result = np.append(result, 0).astype(np.int32)
        self.rank = np.append(rank, _NONE).astype(np.int32)

        self.byte = np.zeros(256, np.int32)
        shown = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                shown.append(bytes((int(name[3:5], 16),)))
            else:
                shown.append(b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else name.replace(SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.array([len(x) for x in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.leads = np.array([name.startswith(SPACE) and not sp.is_byte(i) for i, name in enumerate(names)])
        self.decimal = [str(i) for i in range(n)]
        self._words: dict[str, bytes] = {}
        self._held = 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        """One a worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    # ---- merging ------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; no rank where there is no piece."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.result[at]

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of the words that follow one another in ``symbols``, and how many each word has."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbols))
        done = []
        rank, made = self._of_neighbours(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            live = np.repeat(least < _NONE, sizes)
            done.append((place[~live], symbols[~live]))
            best = np.repeat(least, sizes)[live]
            symbols, word, place, rank, made = (x[live] for x in (symbols, word, place, rank, made))
            if not len(symbols):
                break
            at = np.flatnonzero(rank == best)
            # of occurrences that overlap, every second one from the left
            first = np.diff(at, prepend=-2) != 1
            at = at[(at - at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]) % 2 == 0]
            at = self._first_only(at, symbols, word, rank, made)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, place, rank, made = (x[keep] for x in (symbols, word, place, rank, made))
            at -= np.arange(len(at))
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched], made[touched] = self._of_neighbours(symbols, word, touched)
        place, symbols = (np.concatenate(x) for x in zip(*done)) if done else (place, symbols)
        ends = np.cumsum(lengths)
        order = np.argsort(place)
        return symbols[order], np.diff(np.searchsorted(place[order], ends), prepend=0)

    def _of_neighbours(self, symbols, word, at) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at ``at``."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self._pairs(symbols[at], symbols[after])
        rank[(word[at] != word[after]) | (after == at)] = _NONE
        return rank, made

    def _first_only(self, at, symbols, word, rank, made) -> np.ndarray:
        """Leaves only the leftmost merge of a word where one of several makes a pair that comes before the others."""
        own = word[at]
        several = np.flatnonzero((own == np.roll(own, 1)) | (own == np.roll(own, -1))) if len(at) > 1 else []
        if not len(several):
            return at
        i = at[several]
        m = made[i]
        n = len(symbols)
        right = np.minimum(i + 2, n - 1)
        late = (i + 2 < n) & (word[right] == word[i]) & (self._pairs(m, symbols[right])[0] <= rank[i])
        left = np.maximum(i - 1, 0)
        merged = np.zeros(n, bool)
        merged[at] = True
        joined = merged[np.maximum(i - 2, 0)] & (i >= 2)
        before = np.where(joined, made[np.maximum(i - 2, 0)], symbols[left])
        late |= (i > 0) & (word[left] == word[i]) & (self._pairs(before, m)[0] <= rank[i])
        if not late.any():
            return at
        wait = np.isin(own, own[several[late]])
        return at[~wait | (np.diff(own, prepend=-1) != 0)]

    def ordered(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols left of one long word: all merges of one rank at a time."""
        n = len(symbols)
        symbols = np.append(symbols, np.int32((1 << _SHIFT) - 1))  # a last one that nothing joins
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = n
        rank = np.append(self._pairs(symbols[:-1], symbols[1:])[0], _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(at))):
                r = int(own[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[a:b])

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            first = np.append(True, after[at[:-1]] != at[1:])
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
            second = after[at]
            made = self._pairs(symbols[at], symbols[second])[1]
            left = before[at]
            joined = np.append(False, second[:-1] == left[1:])
            beside = np.where(joined, np.append(made[:1], made[:-1]), symbols[left])
            early = self._pairs(made, symbols[after[second]])[0] <= r
            early |= (left >= 0) & (self._pairs(beside, made)[0] <= r)
            upto = int(np.argmax(early)) + 1 if early.any() else len(at)
            rest, at, second = at[upto:], at[:upto], second[:upto]
            symbols[at] = made[:upto]
            symbols[second] = -1
            rank[second] = _NONE
            after[at] = after[second]
            before[after[at]] = at
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            rank[touched] = self._pairs(symbols[touched], symbols[after[touched]])[0]
            add(np.concatenate([touched, rest]))
        return symbols[:-1][symbols[:-1] >= 0]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, as bytes."""
        sizes = np.array([len(w) + 1 for w in words])
        points = np.frombuffer("".join(" " + w for w in words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        symbols = self.char[points]
        long = sizes > LONG
        short = np.repeat(~long, sizes)
        left, counts = self.rounds(symbols[short], sizes[~long])
        made, cuts = [], np.cumsum(counts)
        chars, char_ends = points[short], np.cumsum(sizes[~long])
        if len(left) and left.max() >= self.inside:  # words with characters that have no piece, one by one
            odd = np.unique(np.searchsorted(cuts, np.flatnonzero(left >= self.inside), "right"))
        else:
            odd = np.zeros(0, int)
        data = left.tobytes()
        cuts4 = np.append(0, cuts * 4).tolist()
        made = [data[a:b] for a, b in zip(cuts4, cuts4[1:])]
        for k in odd.tolist():
            a, b = cuts[k] - counts[k], cuts[k]
            made[k] = self._fallback(left[a:b], chars[char_ends[k] - sizes[~long][k] : char_ends[k]])
        for w, ids in zip((w for w, big in zip(words, long.tolist()) if not big), made):
            self._words[w] = ids
            self._held += 2 * len(w) + len(ids) + 150
        for k in np.flatnonzero(long).tolist():
            own = slice(ends[k] - sizes[k], ends[k])
            ids = self._fallback(self.ordered(symbols[own]), points[own])
            self._words[words[k]] = ids
            self._held += 2 * len(words[k]) + len(ids) + 150

    def _fallback(self, symbols: np.ndarray, points: np.ndarray) -> bytes:
        """Bytes of the ids, with byte pieces for characters that have none."""
        odd = symbols >= self.inside
        if not odd.any():
            return symbols.astype(np.int32).tobytes()
        # these symbols are single characters: the ones of the word that have no piece, in order
        raw = [c.encode() for c in points[self.char[points] >= self.inside].astype("<u4").tobytes().decode("utf-32-le")]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = [len(c) for c in raw]
        out = np.repeat(symbols, counts)
        out[np.repeat(odd, counts)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32).tobytes()

    # ---- whole texts --------------------------------------------------------

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more entry than texts)."""
        split = []
        for text in texts:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if not text:
                split.append([])
            elif self.cross:
                split.append([text])
            elif "  " in text or text[0] == " " or text[-1] == " ":
                split.append([w[1:] for w in re.findall(" +[^ ]*", " " + text)])
            else:
                split.append(text.split(" "))
        if self._held > REMEMBERED:
            self._words, self._held = {}, 0
        new = set().union(*split).difference(self._words)
        if new:
            self._learn(list(new))
        get = self._words.__getitem__
        tail = np.array([self.end], np.int32).tobytes() if end else b""
        made = [b"".join(map(get, own)) + tail for own in split]
        return np.frombuffer(b"".join(made), np.int32), np.cumsum([0] + [len(x) // 4 for x in made])

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each range of ids."""
        sizes, start = self.size[ids], self.start[ids].copy()
        # the space that encoding put in front goes
        seen = np.flatnonzero(~self.control[ids])
        first = np.append(seen, len(ids))[np.searchsorted(seen, cuts[:-1])]
        first = first[first < cuts[1:]]
        first = first[self.leads[ids[first]]]
        sizes[first] -= 1
        start[first] += 1
        ends = np.cumsum(sizes)
        data = self.shown[np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.append(0, ends)[cuts].tolist()
        return [_valid(data[a:b]) for a, b in zip(at, at[1:])]


def _valid(data: bytes) -> bytes:
    return data if data.isascii() else data.decode("utf-8", "statuta.each").encode()


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, end: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row; ``end`` adds the end id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, cuts = Pieces.of(model).encode([x or "" for x in part.column("text").to_pylist()], end)
                yield pa.record_batch([part.column("key"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], ["key", "ids"])

    return _rows(docs, key, text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids are none."""

    def run(batches):
        for batch in batches:
            own = batch.column("ids").fill_null([])
            cuts = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = Pieces.of(model).decode(own.flatten().to_numpy(zero_copy_only=False), cuts)
            yield pa.record_batch([batch.column("key"), pa.array([t.decode() for t in texts], pa.string())], ["key", "text"])

    chosen = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded with an end id, and those ids decoded."""

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                pieces = Pieces.of(model)
                ids, cuts = pieces.encode([x or "" for x in part.column("text").to_pylist()])
                names = list(map(pieces.decimal.__getitem__, ids.tolist()))
                at = cuts.tolist()
                shown = [sha(" ".join(names[a:b]).encode()) for a, b in zip(at, at[1:])]
                texts = list(map(sha, pieces.decode(ids, cuts)))
                yield pa.record_batch(
                    [part.column("key"), pa.array(np.diff(cuts), pa.int64()), pa.array(shown, pa.string()), pa.array(texts, pa.string())],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return _rows(docs, key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
