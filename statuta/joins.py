"""Joins whose small side is measured before it is broadcast, and salted when it is not small."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 32


def within(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    measure: DataFrame | int | None = None,
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join on ``on``.

    ``small`` is broadcast only when known to be within ``rows``: by a row bound given as
    ``measure``, or by counting ``measure``, a cheaper table of at least as many rows.
    Otherwise the join is shuffled, and a key that fills much of ``big`` is split over
    ``salts`` tasks: each ``big`` row takes one salt from ``spread``, each ``small`` row
    is repeated per salt.
    """
    if measure is not None and (measure <= rows if isinstance(measure, int) else within(measure, rows)):
        return big.join(F.broadcast(small), on)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")


#: A Bloom filter has blocks of so many bits, so many blocks at most (16 MB), about so many bits a key, and sets so many of them.
BLOCK_BITS = 1 << 15
MOST_BLOCKS = 4096
BITS_A_KEY = 16
SET_BITS = 3


def maybe_listed(table: DataFrame, keys: DataFrame, on: list[str], bound: int, otherwise: Column | None = None) -> DataFrame:
    """Rows of ``table`` whose key may be among the at most ``bound`` rows of ``keys``, and those where ``otherwise`` holds.

    A blocked Bloom filter of the keys, never over 16 MB, is broadcast to where the table is read, so what is not listed is
    dropped before anything is shuffled. A few rows too many pass; none is lost.
    """
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_BITS < bound * BITS_A_KEY:
        blocks *= 2
    shifted = lambda n: F.call_function("shiftrightunsigned", F.xxhash64(*on), F.lit(n))
    block = F.pmod(shifted(48), F.lit(blocks)).cast("int")
    bits = [F.pmod(shifted(15 * k), F.lit(BLOCK_BITS)).cast("int") for k in range(SET_BITS)]
    word, at = (lambda b: F.floor(b / 64).cast("int")), (lambda b: F.pmod(b, F.lit(64)).cast("int"))
    one = keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("b")).select("_block", word(F.col("b")).alias("w"), at(F.col("b")).alias("b"))
    words = one.groupBy("_block", "w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v"))
    filled = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    sketch = F.broadcast(filled.select("_block", dense.alias("_words")))
    hit = reduce(lambda a, b: a & b, [F.call_function("getbit", F.get("_words", word(b)), at(b)) == 1 for b in bits])
    marked = table.withColumn("_block", block).join(sketch, "_block", "inner" if otherwise is None else "left")
    return marked.filter(hit if otherwise is None else F.coalesce(hit, F.lit(False)) | otherwise).drop("_block", "_words")


def lookup(ranked: DataFrame, table: DataFrame, on: list[str], bound: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach columns of a large table to a list of at most ``bound`` rows.

    A short list is broadcast and the table scanned in place. For a long one, only rows of the table that may be listed are
    shuffled; adaptive execution splits a row that very many list rows want.
    """
    if bound <= rows:
        return table.join(F.broadcast(ranked), on)
    return ranked.join(maybe_listed(table, ranked.select(*on), on, bound), on)
