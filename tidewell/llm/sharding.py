"""Reproducible global shuffle into shards (DataFrame functions only).

Rows get global numbers 0..n-1 that depend on their content alone: their places in the order of
(doc_id, size, checksum), by ranks inside ranges and one prefix sum over the ranges' totals.
A Feistel network over a x a numbers (a = ceil(sqrt n)) permutes them; numbers that
land at n or beyond walk on along their cycle.  Shard and slot are the remainder and
the quotient of the permuted number, so either can be computed from the other.

Scale: text is read once and reduced to 32 bytes a row before the only exchange, which deals
equal rows to as many ranges as they need, by where they were read.  The single-task prefix
sum has a row for each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: Round keys, below the prime; any fixed numbers do.
KEYS = (1_664_525, 1_013_904_223, 69_069, 362_437, 521_288_629, 88_675_123, 123_456_789, 40_692)
PRIME = 2**31 - 1


def _round(r, k):
    y = (r + k) % PRIME
    return (y * y) % PRIME * y % PRIME


def feistel(x: int, a: int, keys=KEYS) -> int:
    """One pass of the network over a x a numbers."""
    left, right = divmod(x, a)
    for k in keys:
        left, right = right, (left + _round(right, k)) % a
    return left * a + right


def feistel_column(x: Column, a: int, keys=KEYS) -> Column:
    """The same as a column."""
    a_ = F.lit(a).cast("long")

    def step(s: Column, k: Column) -> Column:
        y = (s["r"] + k) % PRIME
        return F.struct(s["r"].alias("l"), ((s["l"] + (y * y) % PRIME * y % PRIME) % a_).alias("r"))

    start = F.struct(F.call_function("div", x, a_).alias("l"), (x % a_).alias("r"))
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, step, lambda s: s["l"] * a_ + s["r"])


def longest_walk(n: int, a: int, keys=KEYS) -> int:
    """Most extra passes that any number below n needs: the longest chain among the numbers from n to a*a.

    There are fewer than 2a+1 of these, so the bound is exact and cheap.
    """
    if not n:
        return 0
    length: dict[int, int] = {}
    for x in range(n, a * a):
        chain: dict[int, None] = {}
        while x >= n and x not in length and x not in chain:
            chain[x] = None
            x = feistel(x, a, keys)
        if x in chain:  # a cycle of numbers from n on, which no walk enters
            length.update(dict.fromkeys(chain, 0))
            continue
        d = length.get(x, 0) if x >= n else 0
        for c in reversed(chain):
            d += 1
            length[c] = d
    return max(length.values(), default=0)


def permuted(x: Column, n: int, keys=KEYS) -> Column:
    """Cycle-walking Feistel permutation of 0..n-1."""
    a = math.isqrt(max(n - 1, 0)) + 1
    y = feistel_column(x, a, keys)
    for _ in range(longest_walk(n, a, keys)):
        y = F.transform(F.array(y), lambda v: F.when(v < n, v).otherwise(feistel_column(v, a, keys)))[0]
    return y


def shard(docs: DataFrame, n_shards: int = 8, keys=KEYS) -> DataFrame:
    """Return a row for each row of `docs`: doc_id, size, text_crc32, row_number, permuted, shard, slot.

    Shards differ by at most one row; slots have no gaps.  A null text counts as empty
    (size 1), a null doc_id sorts first.  Equal rows get different numbers.  No rows:
    an empty result.  Other columns of `docs` are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__read"),
    )
    rows = scratch.written(rows, "shard-rows")
    n = rows.count()
    order = ["doc_id", "size", "text_crc32", "__read"]
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = scratch.written(local.select(*order[:3], F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__at")), "shard-ranges")
    totals = local.groupBy("__part").agg(F.count(F.lit(1)).alias("total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    # A row for each range of the exchange.
    numbered = local.join(F.broadcast(starts), "__part").select(*order[:3], (F.col("start") + F.col("__at")).alias("row_number"))
    out = numbered.withColumn("permuted", permuted(F.col("row_number"), n, keys))
    return out.withColumns({"shard": (F.col("permuted") % n_shards).cast("int"), "slot": F.call_function("div", F.col("permuted"), F.lit(n_shards).cast("long"))})
