"""Packing of tokenized documents into windows of a fixed length by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every shorter document, is one piece. Pieces
go by length, longest first, each to the open window with the least room that holds it, which a segment tree over the room finds;
where none holds it a window is opened. Pieces of one length are alike, so the driver plans with the number of pieces of each length
(at most one number per token of a window, however large the corpus): one plan row sends a range of equal pieces to a range of equal
windows. The tasks then look up their pieces' places by length and rank, where ranks come from counts of salted blocks.

Defined cases: a null text is an empty one, and an empty document is the closing id alone; rows with equal keys, texts or both are
packed one by one; a null key is a key; an empty table gives an empty result; a text of any length is tokenized whole; other columns
are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.llm.words import slices
from statuta.session import stored

WINDOW = 2048
CLOSING = 1
#: Rows of equal length that one task numbers, about.
BLOCK_ROWS = 50_000
LEAST_SALTS = 64
#: Bytes of words and their ids that a task remembers, about.
REMEMBERED = 48 << 20


class Tokenizer:
    """Ids of texts as little-endian 32-bit bytes, with a bounded memory of words.

    The tokenizer never joins what a space or line feed parts, nor a letter with a mark after it; so a text's ids are
    those of its words one after another. Plain words (Latin letters, then marks) take a quick path where the file
    allows it: the same merges over bytes, where the last byte of a word has a value of its own, as a word's end has
    in the vocabulary. All else goes to the tokenizer itself.
    """

    _made: dict = {}
    _PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$&*#]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Loaded

        self._loaded = Loaded.from_file(path)
        self._ids: dict[str, bytes] = {"": b""}
        self._held = 0
        self._quick = _byte_merges(self._loaded)

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        """One a worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _exact(self, words: list[str]) -> None:
        for word, found in zip(words, self._loaded.encode_batch_fast(words, add_special_tokens=False)):
            self._ids[word] = array("I", found.ids).tobytes()

    def _learn(self, words) -> None:
        if self._quick is None:
            return self._exact(list(words))
        ids, others, plain = self._ids, [], self._PLAIN.fullmatch
        for word in words:
            found = plain(word)
            if not found:
                others.append(word)
                continue
            core, marks = found.groups()
            own = ids.get(core)
            if own is None:
                own = ids[core] = array("I", self._quick(_ended(core))).tobytes()
            if marks:
                if marks not in ids:
                    self._exact([marks])
                ids[word] = own + ids[marks]
        if others:
            self._exact(others)

    def ids(self, texts: list[str]) -> list[bytes]:
        words = [text.replace("\n", " ").split(" ") for text in texts]
        if self._held > REMEMBERED:
            self._ids, self._held = {"": b""}, 0
        for own in words:
            new = set(own).difference(self._ids)
            self._learn(new)
            self._held += sum(150 + 5 * len(word) for word in new)
        get = self._ids.__getitem__
        return [b"".join(map(get, own)) for own in words]


def _ended(word: str) -> bytes:
    """The bytes of a lower-cased word of Latin letters; the last one is moved to a value below all letters."""
    data = word.lower().encode()
    return data[:-1] + bytes((data[-1] - 0x60,))


def _byte_merges(loaded):
    """Ids of a word's bytes by the file's merges, or None where the file is of another kind.

    Byte-pair ids are the order of the merges, so joining the adjacent pair of the lowest id is the same work.
    """
    import json

    import tiktoken

    model = json.loads(loaded.to_str())["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes((b,)): 1_000_000 + b for b in range(256)}
    for token, i in model["vocab"].items():
        end = token.endswith("</w>")
        data = [byte.get(c, -1) for c in token.removesuffix("</w>")]
        if data and all(0x61 <= b <= 0x7A or 0x80 <= b <= 0xBF or b == 0xC3 for b in data) and not (end and data[-1] == 0xC3):
            ranks[bytes([*data[:-1], data[-1] - 0x60 * end])] = i
    quick = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    sample = [t.removesuffix("</w>") for t in list(model["vocab"])[512:40_000:37]]
    sample = [a + b for a, b in zip(sample, sample[1:]) if (a + b).isascii() and (a + b).isalpha()]
    same = all(quick(_ended(w)) == e.ids for w, e in zip(sample, loaded.encode_batch_fast(sample, add_special_tokens=False)))
    return quick if same else None


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing: int = CLOSING, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, and with ``ids`` the ids) of at most ``window`` ids; the last piece ends with ``closing``."""
    end = np.array([closing], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                own, rows, found = [], [], []
                for i, data in enumerate(Tokenizer.of(tokenizer).ids([x or "" for x in part.column("text").to_pylist()])):
                    data += end
                    for at in range(0, len(data), 4 * window):
                        piece = data[at : at + 4 * window]
                        own.append(i)
                        rows.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
                        if ids:
                            found.append(np.frombuffer(piece, "<i4"))
                columns = [part.column("key").take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4))]
                yield pa.record_batch(columns + [pa.array(found, pa.list_(pa.int32()))] * ids, names[: len(columns) + ids])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


class Rooms:
    """Which amounts of room some open window has: a segment tree whose leaves are the amounts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, room: int, there: bool) -> None:
        at = room + self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest amount of at least ``least`` that is there."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # a right child: go on above
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last amount
                return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], window: int = WINDOW, first: int = 0) -> np.ndarray:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Rows (length, rank from, first window, pieces a window, offset): the pieces of a length from that rank on, to the next
    row's, fill consecutive windows, so many each, from that offset on. Windows are numbered from ``first``.
    """
    rooms, open_, rows = Rooms(window), {}, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, each = window, window // length
                start, n = first, -(-left // each)
                first += n
            else:
                each = room // length
                start, n = open_[room].pop()
                if not open_[room]:
                    rooms.mark(room, False)
            full = min(n, left // each)
            use, each = (full, each) if full else (1, left)
            rows.append((length, rank, start, each, window - room))
            rank, left = rank + use * each, left - use * each
            for amount, at, k in ((room - each * length, start, use), (room, start + use, n - use)):
                if k and amount:
                    if not open_.setdefault(amount, []):
                        rooms.mark(amount, True)
                    open_[amount].append((at, k))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing: int = CLOSING, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of ``cut`` with their places: sequence_id and offset, both from 0 without a gap."""
    found = stored(cut(docs, tokenizer, window, closing, ids, key, text), "pieces")
    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    salts = max(LEAST_SALTS, max(sizes.values(), default=0) // BLOCK_ROWS)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(salts)).cast("int"))
    blocks = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = blocks.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_salt").orderBy(key, "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_inside", inside).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_inside"))

    whole = sizes.pop(window, 0)
    rows = np.concatenate([np.array([[window, 0, 0, 1, 0]], np.int64), plan(sizes, window, whole)])
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    lines = (rows[:, 0] << 44) + rows[:, 1]
    names = found.columns

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            own = rows[np.searchsorted(lines, (length << 44) + rank, "right") - 1]
            at = rank - own[:, 1]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(own[:, 2] + at // own[:, 3]), pa.array(own[:, 4] + length * (at % own[:, 3]))],
                [*names, "sequence_id", "offset"],
            )

    schema = found.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
