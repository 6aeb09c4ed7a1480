"""Exact top-k search by inner product with one KD-tree a shard.

Rows are dealt to shards of bounded size. In a task, a shard's vectors are split at the median of the widest dimension, and every
node keeps its tight bounding box. A box bounds the inner product with a query from above: in every dimension the better of its two
edges counts. A query descends from the root, always into the node of the best bound, and stops where that is below its k-th score so
far. Shards are searched in waves of growing size, and the k-th score of all waves before is where the next one starts.

A shard's tree is made once, in the task that holds its rows, and the queries stream past it; neither side is broadcast.

Defined cases: a vector that is null, or holds a null, NaN or infinite component, takes no part; vectors meet only those of as many
components; a query's candidates are all rows but its own, so also others of its id; equal rows (id and vector) are candidates one by
one, and ask once; unlike vectors of one id ask each; ties go to the smaller id; fewer candidates than k give fewer rows; an empty
table gives an empty result. Scores are exact: sums that doubles cannot hold exactly are taken in 64-bit integers, and those that
these cannot hold are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.session import stored

SHARD_ROWS = 4096
#: Queries searched together at most.
QUERY_ROWS = 2048
LEAF = 128
#: How many times as many shards a wave has as all before it.
WAVES = 4
SCALE = 256.0


def integral(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(id, dimensions, v) of the rows that take part: every component is floor(scale * x) as a double."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(counts)), counts)
            numbers = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.bincount(of[~np.isfinite(numbers)], minlength=len(counts)) > 0
            good = ~bad & lists.is_valid().to_numpy(zero_copy_only=False)
            values = np.floor(numbers[good[of]] * scale) + 0.0
            cuts = np.concatenate([[0], np.cumsum(counts[good])]).astype(np.int32)
            keep = pa.array(good)
            yield pa.record_batch([batch.column("id").filter(keep), pa.array(counts[good].astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], ["id", "dimensions", "v"])

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(vector), F.array().cast("array<float>")).cast("array<double>").alias("v"), F.col(vector).isNull().alias("none"))
    return rows.filter(~F.col("none")).select("id", "v").mapInArrow(run, "id long, dimensions int, v array<double>")


class Tree:
    """A KD-tree over rows: nodes with their tight boxes, children, and the ranges of the reordered rows that they hold."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, numbers: np.ndarray | None = None):
        numbers = ids if numbers is None else numbers
        order, at = [], 0
        low, high, self.left, self.right, self.start, self.end = [], [], [], [], [], []
        waiting = [(np.arange(len(rows)), -1, 0)]
        while waiting:
            own, parent, side = waiting.pop()
            node = len(low)
            low.append(rows[own].min(0))
            high.append(rows[own].max(0))
            for ends in (self.left, self.right, self.start, self.end):
                ends.append(-1)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            if len(own) > LEAF:
                # a median split of the widest dimension; rows that are all alike are halved as they are
                wide = int(np.argmax(high[-1] - low[-1])) if rows.shape[1] else 0
                half = len(own) // 2
                if rows.shape[1] and high[-1][wide] > low[-1][wide]:
                    own = own[np.argpartition(rows[own, wide], half)]
                waiting += [(own[half:], node, 1), (own[:half], node, 0)]
            else:
                # in order of ids, so that the first of equal scores is the smaller one
                order.append(own[np.lexsort((numbers[own], ids[own]))])
                self.start[node], at = at, at + len(own)
                self.end[node] = at
        order = np.concatenate(order)
        self.ids, self.rows, self.numbers = ids[order], rows[order], numbers[order]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right = np.array(self.left), np.array(self.right)
        self.visited = 0

    def bounds(self, queries: np.ndarray, nodes) -> np.ndarray:
        """Queries x nodes: no row in the node's box scores more."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T


def search(tree: Tree, asked: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best k ids and scores of each query by best-first descent from the root; ``asked`` are the numbers of the queries' own rows.

    Every query has a frontier of nodes with their bounds. In a round each takes the best one, and stops where that bound is below
    its k-th score so far, or ``floor``: a node's children are looked at only once it is taken, so what lies below a node that is
    never taken is never bounded. Queries that take the same node are worked on together. Missing places have id -1 and the lowest score.
    """
    largest = (np.abs(queries).max(initial=0) + 1) * (np.abs(tree.rows).max(initial=0) + 1) * max(1, queries.shape[1])
    exact = largest < 2.0**53
    if not exact and largest >= 2.0**63:
        raise OverflowError("inner products beyond 64-bit integers")
    none = -np.inf if exact else np.iinfo(np.int64).min
    n = len(queries)
    scores, ids = np.full((n, k), none), np.full((n, k), -1, np.int64)
    rows = tree.rows if exact else tree.rows.astype(np.int64)
    values = queries if exact else queries.astype(np.int64)
    # bounds that are rounded are raised by what rounding can take
    slack = 0.0 if exact else largest * 2.0**-50
    frontier = np.full((n, len(tree.left)), -np.inf)
    if n:
        frontier[:, 0] = tree.bounds(queries, [0])[:, 0] + slack
    active = np.arange(n)
    while len(active):
        node = frontier[active].argmax(1)
        bound = frontier[active, node]
        go = (bound > -np.inf) & (bound >= np.maximum(scores[active, -1], floor[active]))
        active, node = active[go], node[go]
        frontier[active, node] = -np.inf
        for one in np.unique(node):
            mine = active[node == one]
            if tree.left[one] >= 0:
                children = [tree.left[one], tree.right[one]]
                frontier[mine[:, None], children] = tree.bounds(queries[mine], children) + slack
                continue
            tree.visited += len(mine)
            a, b = tree.start[one], tree.end[one]
            part = values[mine] @ rows[a:b].T
            part = np.where(asked[mine][:, None] == tree.numbers[a:b][None, :], scores.dtype.type(none), part)
            best = np.argsort(-part if exact else ~part, 1, kind="stable")[:, :k]
            both = np.concatenate([scores[mine], np.take_along_axis(part, best, 1)], 1)
            who = np.concatenate([ids[mine], tree.ids[a:b][best]], 1)
            who = np.where(both == none, -1, who)
            first = np.lexsort((who, -both if exact else ~both), -1)[:, :k]
            scores[mine], ids[mine] = np.take_along_axis(both, first, 1), np.take_along_axis(who, first, 1)
    return ids, scores


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(k: int):
    """Rows and then queries of one shard follow one another in sorted partitions: the tree is made once, and queries stream past it."""
    schema = ["query", "query_id", "vec_id", "score"]

    def run(batches):
        shard, rows, tree = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("shard", "dimensions", "role")])
            cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if shard != (own := tuple(marks[:2, a])):
                    shard, rows, tree = own, [], None
                if marks[2, a] == 0:
                    rows.append(part)
                    continue
                if tree is None and rows:
                    whole = pa.concat_tables(rows)
                    tree, rows = Tree(whole["id"].to_numpy(), _matrix(whole), whole["number"].to_numpy()), []
                for at in range(0, part.num_rows if tree else 0, QUERY_ROWS):
                    asking = part.slice(at, QUERY_ROWS)
                    numbers, floor = asking["number"].to_numpy(), asking["floor"].to_numpy()
                    ids, scores = search(tree, numbers, _matrix(asking), k, floor)
                    there = scores > np.iinfo(np.int64).min if scores.dtype.kind == "i" else np.isfinite(scores)
                    there &= scores >= floor[:, None]
                    found = [np.repeat(numbers, k)[there.ravel()], np.repeat(asking["id"].to_numpy(), k)[there.ravel()], ids[there], scores[there].astype(np.int64)]
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in found], schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, waves: int = WAVES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each row where ``asked`` (a condition on ``id``) holds.

    Shards are searched in waves, each ``waves`` times as many as all before it; a wave starts from the k-th scores of those before.
    """
    rows = stored(integral(vectors, key, vector).withColumn("number", F.monotonically_increasing_id()), "rows")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
    columns = ["shard", "dimensions", "role", "number", "id", "v", "floor"]
    low = F.lit(float("-inf"))
    # equal rows ask once
    queries = rows.filter(asked).groupBy("id", "dimensions", "v").agg(F.min("number").alias("number"))
    found, done = None, 0
    while done < shards:
        upto = min(shards, max(1, done * (waves + 1)))
        floor = queries.withColumn("floor", low)
        if found is not None:
            # the k-th score so far, where there are k
            known = found.filter(F.col("rank") == k).select(F.col("query").alias("number"), F.col("score").cast("double").alias("floor"))
            floor = queries.join(known, "number", "left").withColumn("floor", F.coalesce("floor", low))
        every = F.sequence(F.lit(done), F.lit(upto - 1)) if upto > done + 1 else F.array(F.lit(done))
        asking = floor.withColumn("shard", F.explode(every)).withColumn("role", F.lit(1)).select(*columns)
        part = rows.filter((F.col("shard") >= done) & (F.col("shard") < upto)).withColumns({"role": F.lit(0), "floor": low}).select(*columns)
        both = part.unionByName(asking).repartition("shard").sortWithinPartitions("shard", "dimensions", "role")
        new = both.mapInArrow(_searched(k), "query long, query_id long, vec_id long, score long")
        found = _best(new if found is None else found.drop("rank").unionByName(new), k)
        done = upto
        if done < shards:
            found = stored(found, "found")
    return found.select("query_id", "rank", "vec_id", "score")


def fiftieth(vectors: DataFrame) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    return nearest(vectors, F.col("id") % 50 == 0)
