"""Hashes of words and character n-grams of many texts at once, as numpy arrays inside a task.

A batch is joined to one byte buffer with a line feed around every text. Hashes of all byte ranges
come from one running sum: ``sum(byte * P**position)``, so a range costs two look-ups. Buffers are
worked on in bounded pieces that end at a separator, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: Bytes of a word at most; a longer run without a separator is several words.
RUN = 2 << 20
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Separators: for words all ASCII but letters and digits, for chunks white space only.
WORD_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPACE_SEPARATORS = np.array([b in b" \t\n\r\v\f" for b in range(256)])
#: Punctuation, symbols and spaces beyond ASCII, and characters of scripts without spaces between words, with their marks.
APART = r"[\p{P}\p{S}\p{Z}\x{85}\x{200B}]"
SINGLE = r"[\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\x{FF70}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"
#: First bytes of UTF-8 characters that may be among those, and those of Latin letters, which are not (but for two signs).
_LEADS = np.array([b == 0xC2 or b >= 0xCA for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class _Powers:
    """Powers of the multiplier and of its inverse, as long as any piece asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE + 4096)
            self.up, self.down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


_POWERS = _Powers()


class Piece:
    """A part of the buffer: it starts and ends with a separator byte."""

    def __init__(self, data: np.ndarray, separators: np.ndarray):
        n = len(data)
        _POWERS.grow(n + 1)
        self.data, self.apart = data, separators[data]
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=total[1:])
        self._total = total
        edge = np.diff(self.apart.view(np.int8))
        self.starts = np.flatnonzero(edge == -1) + 1
        self.ends = np.flatnonzero(edge == 1) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the bytes from each start to before each end."""
        return mix((self._total[ends] - self._total[starts]) * _POWERS.down[starts])

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def prefixes(self, n: int) -> np.ndarray:
        return self.hashes(self.starts, np.minimum(self.starts + n, self.ends))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the ranges of n bytes with no separator inside; one at either end is allowed."""
        before = np.cumsum(self.apart)
        at = np.flatnonzero(before[n - 2 : -1] == before[: -(n - 1)]) if n > 1 else np.flatnonzero(~self.apart)
        return at, self.hashes(at, at + n)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with spaces for all separators beyond ASCII and around each character of a script without spaces."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = texts.buffers()[1]
    if ends is None or not len(texts):
        return texts
    ends = np.frombuffer(ends, np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = data[ends[0] : ends[-1]]
    # a times or division sign is the only such character among Latin letters
    signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if not (_LEADS[data].any() or signs.any()):
        return texts
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, SINGLE, r" \0 "), APART, " ")


def pieces(texts: pa.Array, separators: np.ndarray) -> Iterator[tuple[Piece, np.ndarray]]:
    """Pieces in order, each with the number of the text that every word of the piece lies in.

    Nulls count as empty. Words of one text come in order, over one piece or several. A piece has at most ``RUN`` bytes and its ends;
    a run of more bytes without a separator is cut, from its start on, into several words.
    """
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(texts)
    while at < n:
        size, to = 0, at
        while to < n and (to == at or size + lengths[to] < PIECE):
            size += lengths[to] + 1
            to += 1
        own = texts.slice(at, to - at)
        raw = [x or b"" for x in pc.cast(own, pa.binary() if own.type == pa.string() else pa.large_binary()).to_pylist()]
        if size <= PIECE:
            data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
            marks = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
            piece = Piece(data, separators)
            yield piece, at + np.searchsorted(marks, piece.starts, "right") - 1
        else:  # one long text
            for data in _cuts(np.frombuffer(raw[0], np.uint8), separators):
                piece = Piece(data, separators)
                yield piece, np.full(len(piece.starts), at)
        at = to


_LINE = np.array([10], np.uint8)


def _cuts(data: np.ndarray, separators: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that start and end with a separator: the last one within ``PIECE`` bytes, else the first one after, else one put in."""
    at, n = 0, len(data)
    while at < n:
        near = np.flatnonzero(separators[data[at : at + PIECE]])
        stop = at + int(near[-1]) + 1 if len(near) else 0
        if not len(near):
            far = np.flatnonzero(separators[data[at + PIECE : at + RUN]])
            stop = at + PIECE + int(far[0]) + 1 if len(far) else min(at + RUN, n)
        before = data[at - 1 : at] if at and separators[data[at - 1]] else _LINE
        yield np.concatenate([before, data[at:stop], _LINE[: not separators[data[stop - 1]]]])
        at = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words start (one more entry than texts).

    Words end at Unicode punctuation, symbols and spaces; in scripts without spaces each character is a word.
    """
    found, of = [], []
    for piece, text in pieces(spaced(lowered(texts)), WORD_SEPARATORS):
        found.append(piece.words())
        of.append(text)
    counts = np.bincount(np.concatenate(of), minlength=len(texts)) if of else np.zeros(len(texts), np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text (a longer text is a part of its own)."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(lengths, before + size, "right")))
        yield batch.slice(at, to - at)
        at, before = to, lengths[to - 1]
