"""What the tasks of n-gram search do: counts of a part of the chunks, the vocabulary of a bucket of terms, weights of a part.

Chunks are dealt to parts, terms to buckets. A part sends a bucket each of its distinct terms once, however many of its chunks hold
it, and gets document frequencies back in the same order; what stays in the part are numbers. Functions take and give Arrow tables.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: A task takes at least so many bytes of tokens before it folds them into what it holds, some numbers a distinct n-gram of a chunk.
FOLD_BYTES = 16_000_000

COUNTS = "part long, bucket int, body string, counts binary, chunks array<{}>, sizes binary, numbers binary, tfs binary"
VOCABULARY = "part long, bucket int, body string, dfs binary, places binary, asked binary"
HITS = "chunk_id {}, ids array<long>, weights array<double>"


def packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits as compressed planes of bytes."""
    planes = np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<q", len(values)) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<q", data)
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _hashed(tokens) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) + 1 for t in tokens], np.uint64)


def _bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a term by the hashes of its tokens, the second one zero where there is one token."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _bodies(terms: pa.Array, ends: np.ndarray) -> list:
    """The terms from each end to the next as lines of one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms), "\n").to_pylist()


class _Part:
    """Counts of the n-grams of one part: sorted ``place`` is the row of a chunk times the count of terms, and the term."""

    def __init__(self):
        self.tokens, self.chunks, self.last, self.text = {}, {}, 0, 0
        self.terms, self.place, self.tf = (np.zeros(0, np.int64) for _ in range(3))

    @staticmethod
    def _codes(column: pa.Array, known: dict) -> np.ndarray:
        found = column.dictionary_encode("encode")
        codes = np.array([known.setdefault(v, len(known)) for v in found.dictionary.to_pylist()], np.int64)
        return codes[found.indices.to_numpy()]

    def _grams(self, batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """(row of the chunk, key) of each token and of each pair of neighbours in a text, which may have begun in batches before."""
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = pc.split_pattern(table["tokens"].combine_chunks(), "\n")
        sizes, tokens = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
        some = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(sizes)), sizes)[some]
        text = self.text + np.cumsum(table["pos"].to_numpy() == 0)
        code, row = self._codes(tokens.filter(pa.array(some)), self.tokens), self._codes(table["chunk_id"].combine_chunks(), self.chunks)[line]
        last, self.text = self.text if self.last is not None else -1, int(text[-1])
        text = text[line]
        follows = np.flatnonzero(text == np.concatenate([[last], text[:-1]])) if len(text) else text
        before = np.concatenate([[self.last or 0], code[:-1]])[follows] if len(text) else text
        # the last token of the text that goes on, if it has one
        self.last = int(code[-1]) if len(text) and text[-1] == self.text else self.last if last == self.text else None
        return np.concatenate([row, row[follows]]), np.concatenate([code << 32, before << 32 | code[follows] + 1])

    def add(self, batches: list[pa.RecordBatch]) -> None:
        """Fold lines (chunk_id, pos, tokens) in."""
        row, key = self._grams(batches)
        held = max(1, len(self.terms))
        if len(self.tf):
            row, key = np.concatenate([self.place // held, row]), np.concatenate([self.terms[self.place % held], key])
        number, self.terms = pd.factorize(key)
        del key
        place, tf = row * len(self.terms) + number, self.tf
        del row, number
        if len(tf):
            self.place, at = np.unique(place, return_inverse=True)
            self.tf = np.bincount(at, np.concatenate([tf, np.ones(len(at) - len(tf), np.int64)])).astype(np.int64)
        else:
            self.place, self.tf = np.unique(place, return_counts=True)

    def rows(self, part: int, buckets: int, schema: pa.Schema):
        """A row of distinct terms for each bucket, and one of bucket -1 with the counts: terms are numbered bucket by bucket."""
        m = len(self.terms)
        if not m:
            return
        first, second = self.terms >> 32, (self.terms & 0xFFFFFFFF) - 1
        hashes = _hashed(self.tokens)
        bucket = _bucket(hashes[first], np.where(second < 0, np.uint64(0), hashes[second]), buckets)
        order = np.argsort(bucket, kind="stable")
        renumbered = np.empty(m, np.int64)
        renumbered[order] = np.arange(m)
        row = self.place // m
        place = row * m + renumbered[self.place % m]
        order_ = np.argsort(place)
        row, number, tf = row[order_], place[order_] % m, self.tf[order_]
        del place, order_
        # chunks without an id are one document, which any number of parts may hold
        none = row == self.chunks.get(None, -1)
        counts = 2 * np.bincount(number[~none], minlength=m) + np.bincount(number[none], minlength=m)
        names = pa.array(list(self.tokens), pa.string())
        pair = names.take(pa.array(second[order], mask=second[order] < 0))
        terms = pc.binary_join_element_wise(names.take(pa.array(first[order])), pair, " ", null_handling="skip")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = [b for b in range(buckets) if ends[b] < ends[b + 1]]
        bodies = _bodies(terms, ends)
        for at in range(0, len(some), 1000):
            few = some[at : at + 1000]
            yield _batch(schema, part=[part] * len(few), bucket=few, body=[bodies[b] for b in few], counts=[packed(counts[ends[b] : ends[b + 1]]) for b in few])
        sizes = np.bincount(row, minlength=len(self.chunks))
        starts = np.zeros(len(number), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        steps = np.where(starts, number, np.diff(number, prepend=0))
        yield _batch(schema, part=[part], bucket=[-1], chunks=[list(self.chunks)], sizes=[packed(sizes)], numbers=[packed(steps)], tfs=[packed(tf)])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def count_part(batches, part: int, buckets: int, schema: pa.Schema):
    """Rows ``COUNTS`` of one part from its rows (chunk_id, pos, tokens): the lines of each text in order, from 0, a token a line."""
    counts, waiting, n = _Part(), [], 0
    for batch in (b for b in batches if b.num_rows):
        waiting.append(batch)
        n += batch.column("tokens").nbytes
        if n >= max(FOLD_BYTES, 4 * len(counts.place)):
            counts.add(waiting)
            waiting, n = [], 0
    if waiting:
        counts.add(waiting)
    yield from counts.rows(part, buckets, schema)


def ask(batches, buckets: int, schema: pa.Schema):
    """Rows ``COUNTS`` of part -1 that ask for distinct terms and count nothing."""
    for batch in batches:
        terms = batch.column("term").to_pylist()
        if not terms:
            continue
        split = [t.split(" ") for t in terms]
        second = np.array([_hashed(s[1:2])[0] if len(s) > 1 else 0 for s in split], np.uint64)
        bucket = _bucket(_hashed(s[0] for s in split), second, buckets)
        order = np.argsort(bucket, kind="stable")
        some, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts, len(order))
        bodies = _bodies(pa.array([terms[i] for i in order], pa.string()), ends)
        yield _batch(schema, part=[-1] * len(some), bucket=some, body=bodies, counts=[packed(np.zeros(n, np.int32)) for n in np.diff(ends)])


def bucket_vocabulary(table: pa.Table, least: int, most: float, schema: pa.Schema) -> pa.Table:
    """Rows ``VOCABULARY`` of one bucket: to each part its terms' document frequencies (0: not in the vocabulary), and where
    the asked ones are; of part -1 the asked terms themselves."""
    bucket, part = table["bucket"][0].as_py(), table["part"].to_numpy()
    lists = pc.split_pattern(table["body"].combine_chunks(), "\n")
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    found = lists.flatten().dictionary_encode()
    number, m = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
    counts = np.concatenate([unpacked(x) for x in table["counts"].to_pylist()])
    df = np.bincount(number, counts >> 1, m).astype(np.int64) + (np.bincount(number, counts & 1, m) > 0)
    df[(df < least) | (df > most)] = 0
    asked = np.zeros(m, bool)
    asked[number[np.repeat(part < 0, np.diff(ends))]] = True
    asked &= df > 0
    out = {"part": [], "bucket": [], "body": [], "dfs": [], "places": [], "asked": []}

    def give(*values):
        for column, value in zip(out.values(), values):
            column.append(value)

    for i in np.flatnonzero(part >= 0):
        own = number[ends[i] : ends[i + 1]]
        places = np.flatnonzero(asked[own])
        give(int(part[i]), bucket, None, packed(df[own]), packed(places), packed(own[places]))
    some = np.flatnonzero(asked)
    if len(some):
        give(-1, bucket, "\n".join(found.dictionary.take(pa.array(some)).to_pylist()), packed(df[some]), None, packed(some))
    return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def asked_terms(batches, n: int):
    """(term, id, idf) of the asked terms in the vocabulary, from the rows of part -1."""
    for batch in batches:
        for bucket, body, dfs, asked in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "dfs", "asked"))):
            ids = (bucket << 32) + unpacked(asked).astype(np.int64)
            yield pa.record_batch([pa.array(body.split("\n"), pa.string()), pa.array(ids), pa.array(inverse_frequency(unpacked(dfs), n))], ["term", "id", "idf"])


def part_hits(table: pa.Table, n: int, schema: pa.Schema) -> pa.Table:
    """Rows ``HITS`` of one part from its counts and what the buckets answered: the asked terms of each chunk, weighted by unit length."""
    bucket = table["bucket"].to_numpy()
    own = int(np.flatnonzero(bucket < 0)[0])
    answers = [int(i) for i in np.argsort(bucket, kind="stable") if bucket[i] >= 0]
    one, two, three = (table[c] for c in ("one", "two", "three"))
    read = lambda column, i: unpacked(column[i].as_py())
    dfs = [read(one, i) for i in answers]
    ends = np.cumsum([0] + [len(x) for x in dfs])
    df = np.concatenate(dfs)
    idf = np.where(df > 0, inverse_frequency(df, n), 0.0)
    id_ = np.full(len(df), -1, np.int64)
    for i, at in zip(answers, ends):
        id_[at + read(two, i)] = (int(bucket[i]) << 32) + read(three, i).astype(np.int64)
    sizes, steps, tf = read(one, own), read(two, own).astype(np.int64), read(three, own)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # steps start anew with each chunk
    total = np.cumsum(steps)
    base = np.append(0, total)[np.cumsum(sizes) - sizes]
    number = total - base[row]
    weight = (1 + np.log(tf)) * idf[number]
    norm = np.sqrt(np.bincount(row, weight * weight, len(sizes)))
    chunks = table["chunks"][own].values
    known = chunks.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero((id_[number] >= 0) & known[row])
    some, starts = np.unique(row[at], return_index=True)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(values))
    columns = [chunks.take(pa.array(some)), lists(id_[number[at]]), lists(weight[at] / norm[row[at]])]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
