"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded and verified.

A text is the multiset of its shingles of five words (of all its words where it has fewer). Every shingle owns Poisson processes, one
for each dyadic interval [0,1), [1,2), [2,4), ... of the weight axis, so a count c costs as many processes as c has binary digits. A
point has a time, a uniform position in its interval and a uniform component; a shingle with count c shows the points at positions
below c. A component keeps the earliest time over all shingles of the text, so two texts agree in a component with the probability of
their weighted Jaccard similarity. Points later than a limit that nearly always fills every component are never made; the few texts
it does not fill are done again with a later limit.

Equal multisets are one class from the start; from there one row stands for each. Texts that share a band of components are
candidates. In each band bucket all rows meet the bucket's smallest id, and the overlap of both multisets decides. Then connected
components are taken. In the buckets that still hold several components, the signatures of rows of different components are compared,
part by part, in the first bucket that both share. Rows with a partner that agrees in ``LIKELY`` of the components bring their texts
to that bucket, and are verified there, the likeliest pairs first, until no two components are left to compare. Only links leave a
task, at most one a row. So every pair that shares a band is verified, joined by a chain of verified pairs, or too far apart in its
signatures: a pair of similarity 0.8 shares no band with a probability of 7e-5, and falls below ``LIKELY`` with one of 2e-5.

Defined cases: a null key or text is in no class with others; texts without a word are a class where they are equal; rows of one key
are told apart by their rows, and keys may be of any type with an order; ties go to the smaller id; the class id is the smallest id of the class; an empty table gives an empty result;
texts are read whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.joins import BROADCAST_ROWS, within
from statuta.llm.words import mix, slices, unit, word_hashes
from statuta.session import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Share of equal components from which two rows are worth their texts.
LIKELY = 0.65
#: Rows, and shingles, of a bucket's part, about; every two parts meet in one task.
SIDE, SIDE_SHINGLES = 2048, 1 << 20
#: Rows that meet one head in one task, about.
TOGETHER = 256

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, and where each text's shingles start."""
    words, cuts = word_hashes(texts)
    odd = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(n)], np.uint64)
    joined = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        joined += words[i : i + len(joined)] * odd[i]
    joined = mix(joined)
    values, counts, sizes = [], [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if b - a >= n:
            own = np.sort(joined[a : b - n + 1])
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            values.append(own[new])
            counts.append(np.diff(new, append=len(own)))
        elif b > a:
            values.append(mix((words[a:b] * odd[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            counts.append(np.ones(1, np.int64))
        else:
            continue
        sizes[i + 1] = len(values[-1])
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(values or none[0]), np.concatenate(counts or none[1]), np.cumsum(sizes)


def _points(seed, rate, low, weight, at, limit, out) -> None:
    """Put the earliest times of all visible points up to each process's limit into ``out`` (place = text * components + component).

    ``low``: start of the interval, 0 for [0,1); ``at``: first place of the text.
    """
    whole = (low == 0) | (2 * low <= weight)

    def show(i, j, x):
        place = at[i] + (mix(seed[i] ^ (j * _STEP[1])) % np.uint64(COMPONENTS)).astype(np.int64)
        part = ~whole[i]
        if part.any():
            position = low[i] + (mix(seed[i] + (j * _STEP[2])) % np.maximum(low[i], 1).astype(np.uint64)).astype(np.int64)
            seen = ~part | (position < weight[i])
            place, x = place[seen], x[seen]
        np.minimum.at(out, place, x)

    u = unit(mix(seed + _STEP[0]))
    i = np.flatnonzero(u >= np.exp(-rate * limit))
    x = -np.log(u[i]) / rate[i]
    j = np.ones(len(i), np.uint64)
    show(i, j, x)
    while len(i):
        left = (limit[i] - x) * rate[i]
        block = 1 << np.clip(np.ceil(np.log2(np.maximum(left, 0) + 1)), 0, 8).astype(np.int64)
        go_i, go_j, go_x = [], [], []
        for b in np.unique(block):
            own = block == b
            k, first = i[own], j[own]
            js = first[:, None] + np.arange(1, b + 1, dtype=np.uint64)
            times = -np.log(unit(mix(seed[k][:, None] + js * _STEP[0]))) / rate[k][:, None]
            times[:, 0] += x[own]
            np.cumsum(times, 1, out=times)
            ok = times <= limit[k][:, None]
            show(np.broadcast_to(k[:, None], ok.shape)[ok], js[ok], times[ok])
            on = ok[:, -1]
            go_i.append(k[on])
            go_j.append(js[on, -1])
            go_x.append(times[on, -1])
        i, j, x = np.concatenate(go_i), np.concatenate(go_j), np.concatenate(go_x)


def signatures(values: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Texts x components: earliest times; a text without shingles has infinities."""
    n = len(cuts) - 1
    out = np.full(n * COMPONENTS, np.inf)
    text = np.repeat(np.arange(n), np.diff(cuts))
    total = np.bincount(text, counts, n)
    limit = (np.log(COMPONENTS) + 4.6) * COMPONENTS / np.maximum(total, 1)
    waiting = total > 0
    while waiting.any():
        own = np.flatnonzero(waiting[text])
        low = 0
        while len(own):
            seed = mix(values[own] + np.uint64((low + 1) * int(_STEP[2]) % (1 << 64)))
            same = np.full(len(own), low, np.int64)
            _points(seed, np.full(len(own), float(max(low, 1))), same, counts[own], text[own] * COMPONENTS, limit[text[own]], out)
            low = 2 * low or 1
            own = own[counts[own] > low]
        waiting &= np.isinf(out.reshape(n, COMPONENTS)).any(1)
        limit[waiting] *= 2
    return out.reshape(n, COMPONENTS)


def band_keys(times: np.ndarray) -> np.ndarray:
    """Texts x bands: a hash of the components of each band."""
    bits = mix(np.ascontiguousarray(times).view(np.uint64)).reshape(len(times), BANDS, ROWS)
    odd = np.array([0xD6E8FEB86659FD93 * (2 * i + 1) % (1 << 64) | 1 for i in range(ROWS)], np.uint64)
    return mix((bits * odd).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP[1])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, one, two, n, bands, sign): a hash of the multiset, the number of shingles, the band keys, and 16 bits of each component."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text")
                values, counts, cuts = shingles(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(cuts))
                n = np.bincount(text, counts, len(texts)).astype(np.int64)
                sums = []
                for step in _STEP[:2]:
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ step) * counts.astype(np.uint64))])
                    sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
                empty = np.flatnonzero(n == 0)
                for i in empty:
                    sums[0][i] = xxhash.xxh3_64_intdigest(texts[int(i)].as_py()) - (1 << 63)
                keys, sign = np.empty((len(texts), BANDS), np.uint64), np.empty((len(texts), COMPONENTS), np.uint16)
                # a few hundred texts at a time keep the points small
                for a in range(0, len(texts), 256):
                    b = min(a + 256, len(texts))
                    x, y = cuts[a], cuts[b]
                    times = signatures(values[x:y], counts[x:y], cuts[a : b + 1] - x)
                    keys[a:b], sign[a:b] = band_keys(times), mix(times.view(np.uint64)) >> np.uint64(48)
                own = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(keys[n > 0].ravel().view(np.int64)))
                rows = pa.array([r.tobytes() for r in sign], pa.binary())
                yield pa.record_batch([part.column("doc_id"), *(pa.array(s) for s in sums), pa.array(n), bands, rows], ["doc_id", "one", "two", "n", "bands", "sign"])

    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, one long, two long, n long, bands array<long>, sign binary")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by at least ``similarity``.

    The texts of a head ``a`` and of the rows that it meets are brought together, in parts of bounded size for a head that meets many.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    member = pairs.join(parts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("head"), F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), F.lit(1).alias("role"))
    lead = parts.select(F.col("a").alias("doc_id"), F.col("a").alias("head"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    need = stored(lead.unionByName(member), "need")
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(need) if within(need, BROADCAST_ROWS) else need, "doc_id")
    rows = rows.repartition("head", "part").sortWithinPartitions("head", "part", "role", "doc_id")

    def run(batches):
        head, own = None, None
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts, cuts = shingles(part.column("text"))
                found = []
                for i, (doc, to, role) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "head", "role")))):
                    v, c = values[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]
                    if role == 0:
                        head, own = to, (v.copy(), c.copy(), c.sum())
                    elif head == to and len(own[0]) and len(v):
                        place = np.minimum(np.searchsorted(own[0], v), len(own[0]) - 1)
                        common = np.where(own[0][place] == v, np.minimum(own[1][place], c), 0).sum()
                        if common >= similarity * (own[2] + c.sum() - common) - 1e-9:
                            found.append((to, doc))
                a, b = zip(*found) if found else ((), ())
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("doc_id", "head", "role", "text").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label) of every node: the smallest id that it is connected with. Labels spread to neighbours and jump to their own labels."""
    both = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("a").alias("other")))
    labels = stored(both.groupBy("doc_id").agg(F.min("other").alias("label")).select("doc_id", F.least("doc_id", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("other"), F.col("label").alias("near")), "other").groupBy("doc_id").agg(F.min("near").alias("near"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "doc_id").join(jump, "label", "left").select("doc_id", "label", F.least("label", "near", "jump").alias("new"))
        new = stored(new, "labels")
        labels = new.select("doc_id", F.col("new").alias("label"))
        if new.filter(F.col("new") != F.col("label")).limit(1).count() == 0:
            return labels


def _fits(a: str, b: str, similarity: float = SIMILARITY):
    """No similarity exceeds the ratio of the sizes."""
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


CELL = ["key", "low", "high"]


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of mixed buckets, once for each two parts that they belong to: a bucket is cut into parts by hash."""
    parts = F.greatest(F.ceil(F.col("size") / SIDE), F.ceil(F.col("total") / SIDE_SHINGLES)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "band", "own", "rep", "n", "label", "sign", "bands")


def _together(rows: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """``fn`` of the rows of each cell; cells follow one another in sorted partitions."""

    def run(batches):
        cell, parts = None, []
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in CELL])
            cuts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if parts and tuple(ids[:, a]) != cell:
                        yield from out(fn(parts))
                        parts = []
                    cell = tuple(ids[:, a])
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from out(fn(parts))

    def out(columns):
        if columns is not None and len(columns[0]):
            yield pa.record_batch([pa.array(c) for c in columns], names)

    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, schema)


class _Cell:
    """Rows of one cell as arrays."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.own, self.rep, self.n, self.root = (table[c].to_numpy().copy() for c in ("own", "rep", "n", "label"))
        self.band = table["band"][0].as_py()
        self.sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        self.bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        first, second = int(table["low"][0].as_py()), int(table["high"][0].as_py())
        self.across = first != second

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that row ``i`` has to be compared with here, and their shares of equal components."""
        to = (self.own > self.own[i]) if self.across else (self.rep > self.rep[i])
        to &= (self.root != self.root[i]) & (np.minimum(self.n, self.n[i]) >= np.maximum(self.n, self.n[i]) * (SIMILARITY - 1e-9))
        to = np.flatnonzero(to)
        # a pair belongs to the first band that both share
        to = to[~(self.bands[to, : self.band] == self.bands[i, : self.band]).any(1)]
        share = (self.sign[to] == self.sign[i]).mean(1)
        return to[share >= LIKELY], share[share >= LIKELY]


def _links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between the components of mixed buckets; ``rows``: key, band, rep, n, label, size, total, sign, bands."""
    cells = stored(_cells(rows), "cells")

    def likely(parts: list[pa.RecordBatch]):
        cell = _Cell(parts)
        wanted = np.zeros(len(cell.rep), bool)
        for i in range(len(cell.rep)):
            to, _ = cell.partners(i)
            wanted[to] = True
            wanted[i] |= len(to) > 0
        at = np.flatnonzero(wanted)
        return [np.repeat(pa.Table.from_batches(parts)[c].to_numpy()[:1], len(at)) for c in CELL] + [cell.rep[at]]

    wanted = stored(_together(cells, likely, "key long, low int, high int, rep long", [*CELL, "rep"]), "wanted")
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    one = wanted.select("rep").distinct()
    texts = texts.join(F.broadcast(one) if within(one, BROADCAST_ROWS) else one, "rep").dropDuplicates(["rep"])
    full = cells.join(wanted, [*CELL, "rep"]).join(texts, "rep")

    def verify(parts: list[pa.RecordBatch]):
        cell = _Cell(parts)
        values, counts, cuts = shingles(pa.concat_arrays([p.column("text") for p in parts]))
        found = []
        for i in range(len(cell.rep)):
            to, share = cell.partners(i)
            v, c = values[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]
            for j in to[np.argsort(-share, kind="stable")]:
                if cell.root[i] == cell.root[j]:
                    continue
                w, d = values[cuts[j] : cuts[j + 1]], counts[cuts[j] : cuts[j + 1]]
                place = np.minimum(np.searchsorted(v, w), len(v) - 1)
                common = np.where(v[place] == w, np.minimum(c[place], d), 0).sum()
                if common >= SIMILARITY * (c.sum() + d.sum() - common) - 1e-9:
                    found.append((cell.rep[i], cell.rep[j]))
                    cell.root[cell.root == cell.root[j]] = cell.root[i]
        return [np.array(x, np.int64) for x in zip(*found)] if found else None

    full = full.select(*CELL, "band", "own", "rep", "n", "label", "sign", "bands", "text")
    return _together(full, verify, "a long, b long", ["a", "b"])


def _classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of) of every row; ids are whole numbers, none of them twice."""
    keys = ["one", "two", "n"]
    found = stored(signed(docs), "signed")
    # written, so that the join can split a multiset that very many rows have
    first = stored(found.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "first")
    lead = F.col("doc_id") == F.col("rep")
    members = stored(found.join(first, keys).select("doc_id", "rep", "n", F.when(lead, F.col("bands")).alias("bands"), F.when(lead, F.col("sign")).alias("sign")), "members")

    # band keys of one row for each multiset
    reps = members.filter(lead & (F.size("bands") > 0))
    rows = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("size"), F.sum("n").alias("total")).filter("size > 1")
    heads = stored(heads, "heads")
    shared = stored(rows.join(heads, "key"), "shared")

    star = shared.filter((F.col("rep") != F.col("head.rep")) & _fits("n", "head.n", similarity)).select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()
    edges = stored(verified(docs, star, similarity), "edges")
    labels = components(edges)

    named = shared.select("key", "band", "rep", "n", "size", "total").join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = stored(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key"), "keys")
    mixed = stored(named.join(mixed, "key"), "mixed")
    signs = mixed.select("rep").distinct()
    signs = reps.select("rep", "sign", "bands").join(F.broadcast(signs) if within(signs, BROADCAST_ROWS) else signs, "rep").dropDuplicates(["rep"])
    more = stored(_links(docs, mixed.join(signs, "rep")), "edges")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))

    return members.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("copy_of"))


def _there() -> Column:
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull()


def _plain(docs: DataFrame) -> bool:
    """Whether the ids of the rows that take part are whole numbers, none of them twice; only the ids are looked at."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return docs.filter(_there()).groupBy("doc_id").count().filter("count > 1").isEmpty()


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows that take part, written with a number each, and the name of that column."""
    number = "row_number"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    return stored(docs.filter(_there()).withColumn(number, F.monotonically_increasing_id()), "rows"), number


def _named(rows: DataFrame, number: str, similarity: float) -> DataFrame:
    """(row, doc_id, class_id, copy_of) of numbered rows: the smallest ids of the class, and of the rows with the same multiset."""
    found = _classes(rows.select(F.col(number).alias("doc_id"), "text"), similarity).withColumnRenamed("doc_id", "row")
    found = stored(found.join(rows.select(F.col(number).alias("row"), "doc_id"), "row"), "found")
    for column in ("class_id", "copy_of"):
        least = found.groupBy(column).agg(F.min("doc_id").alias("_least"))
        found = found.join(least, column).drop(column).withColumnRenamed("_least", column)
    return found.select("row", "doc_id", "class_id", "copy_of")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of) of every row: the smallest id of the near-duplicate class, and of the rows with the same multiset.

    Rows are told apart even where they share an id: unlike texts of one id fall to classes of their own. Ids of any type that has an order do.
    """
    if _plain(docs):
        found, key = _classes(docs.filter(_there()), similarity), F.col("doc_id").cast("long").alias("doc_id")
    else:
        found, key = _named(*_rows(docs), similarity).drop("row"), F.col("doc_id")
    rest = docs.filter(~_there()).select(key)
    return found.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of the smallest id, with all columns; rows without a key or text stay.

    Rows that share an id but not their text are different documents.
    """
    if _plain(docs):
        found = _classes(docs.filter(_there()))
        # the documents that go are far fewer than those that stay
        gone = stored(found.filter("doc_id != class_id").select(F.col("doc_id").alias("out_id")), "gone")
        gone, key = _renamed(gone, docs), "doc_id"
        return docs.join(gone, (F.col(key) == F.col(gone.columns[0])) & F.col("text").isNotNull(), "left_anti")
    rows, number = _rows(docs)
    found = _classes(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"))
    found = stored(found.join(rows.select(F.col(number).alias("row"), "doc_id"), "row"), "found")
    kept = found.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    gone = _renamed(stored(found.join(kept, "row", "left_anti").select(F.col("row").alias("out_id")), "gone"), rows)
    left = rows.join(gone, F.col(number) == F.col(gone.columns[0]), "left_anti").select(*docs.columns)
    return left.unionByName(docs.filter(~_there()))


def _renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The one column of ``rows`` under a name that ``docs`` has not; broadcast where it is counted within the bound."""
    name = rows.columns[0]
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rows = rows.toDF(name)
    return F.broadcast(rows) if within(rows, BROADCAST_ROWS) else rows
