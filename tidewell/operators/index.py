"""Ordered multimap index on (key, ptr): bulk load, lookups, merges of runs, cost model."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bulkload(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """Entries dealt by key ranges and sorted inside, ready to be written as prunable files."""
    dealt = entries.repartitionByRange(partitions, "key", "ptr") if partitions else entries.repartitionByRange("key", "ptr")
    return dealt.sortWithinPartitions("key", "ptr")


def point(entries: DataFrame, key) -> DataFrame:
    """Number of live entries with a key, and the smallest payload."""
    return entries.where(F.col("key") == key).agg(F.count(F.lit(1)).alias("n"), F.min("ptr").alias("ptr"))


def range_count(entries: DataFrame, low, high) -> DataFrame:
    return entries.where(F.col("key").between(low, high)).agg(F.count(F.lit(1)).alias("n"))


def scan_next(entries: DataFrame, key, limit: int) -> DataFrame:
    """The next entries from a key on, in order."""
    return entries.where(F.col("key") >= key).orderBy("key", "ptr").limit(limit)


def sorted_check(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """From (pos, key), pos without gaps: number of rows and of places where a key is below the one before.

    Blocks of positions are checked apart and their borders joined, so no task sees all rows.
    """
    cells = rows.withColumn("__b", F.floor(F.col("pos") / block))
    order = Window.partitionBy("__b").orderBy("pos")
    inner = cells.withColumn("__v", (F.lag("key").over(order) > F.col("key")).cast("int"))
    blocks = inner.groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__v"), F.lit(0)).alias("v"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    border = F.lag("last").over(Window.orderBy("__b")) > F.col("first")  # one row a block
    return blocks.withColumn("v", F.col("v") + F.coalesce(border.cast("int"), F.lit(0))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("violations"))


def run_merge(lower: DataFrame, upper: DataFrame, lowest: bool = True) -> DataFrame:
    """Merge two runs of (key, ptr, is_filter): each filter takes away one equal entry.

    Filters left over stay, unless this is the lowest level.
    """
    both = lower.select("key", "ptr", "is_filter").unionByName(upper.select("key", "ptr", "is_filter"))
    net = both.groupBy("key", "ptr").agg(F.sum(F.when(F.col("is_filter"), -1).otherwise(1)).alias("net"))
    net = net.where("net > 0" if lowest else "net != 0")
    return net.select("key", "ptr", (F.col("net") < 0).alias("is_filter"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("net"))).alias("__n")).drop("__n")


def compaction(levels: list[DataFrame]) -> DataFrame:
    """Merge all levels, newest first, into one without filters."""
    whole = levels[-1]
    for level in reversed(levels[:-1]):
        whole = whole.unionByName(level)
    return run_merge(whole, whole.limit(0)).select("key", "ptr")


def oplog_mix(log: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("op") == op).alias(name) for op, name in (("s", "n_search"), ("i", "n_insert"), ("d", "n_delete"), ("u", "n_update"))]
    mix = log.agg(F.count(F.lit(1)).alias("n"), *counts)
    return mix.withColumns({f"p_{c[2:]}": F.col(c) / F.col("n") for c in ("n_search", "n_insert", "n_delete", "n_update")})


def oplog_pressure(log: DataFrame) -> DataFrame:
    """Share of physical work that inserts: deletes and updates search too, updates insert twice."""
    s, i, d, u = (F.col(c) for c in ("n_search", "n_insert", "n_delete", "n_update"))
    return oplog_mix(log).select(((i + d + 2 * u) / (s + i + 2 * d + 3 * u)).alias("pressure"))


#: Fixed layout of the modelled tree: entries of a page, bytes of an entry and of a page, pages of the head.
ENTRIES, ENTRY, PAGE, HEAD_PAGES = 252, 8, 2048, 256


def fan_out_cost(n: int, memory: int, pressure: float, profile: dict[str, float]):
    """Seconds of one operation on `n` entries as a function of the size ratio k between levels.

    A search reads a page on each level below those that fit in memory.  The cost of an insert
    comes from a simulated round of merges, from half-full levels until the last level is reached:
    filling the head makes it spill, a level that overflows spills into the next, and fences for
    each page of the level below take room.
    """

    def cost(k: int) -> float:
        room = [HEAD_PAGES * PAGE // ENTRY]
        while room[-1] < n or len(room) == 1:
            room.append(room[-1] * k)
        last = len(room) - 1
        held, fences = [0] * last + [n], [0] * (last + 1)
        for i in reversed(range(last)):
            fences[i] = held[i + 1] // ENTRIES
            held[i] = (room[i] + fences[i]) // 2
        read = written = inserted = reached = 0
        while reached < last:
            inserted, held[0], reached = inserted + room[0] - fences[0], room[0], 0
            while reached == 0 or held[reached] >= room[reached] and reached < last:
                up, reached = reached, reached + 1
                read += held[reached] + (held[up] if up else 0)
                written += held[reached] + held[up] - fences[up]
                held[reached] += room[up] - fences[up]
            for i in reversed(range(reached)):
                fences[i] = held[i + 1] // ENTRIES
                held[i] += fences[i] - room[i]
        insert = (read / profile["seqread"] + written / profile["seqwrite"]) * ENTRY / inserted
        cached = max(math.floor(math.log(memory / (room[0] * ENTRY)) / math.log(k)), -1) + 1
        below = last + 1 - cached
        if cached and below > 0:
            below -= (memory / ENTRY - room[0] * k ** (cached - 1)) / room[cached]
        return max(below, 0) * PAGE / profile["rndread"] * (1 - pressure) + insert * pressure

    return cost


def fan_out_costs(spark, n: int, memory: int, pressure: float, profile: dict[str, float]) -> DataFrame:
    """k and cost for each k from 4 to two below a page's entries; a twentieth is added to n for growth."""
    cost = fan_out_cost(int(n * 1.05), memory, pressure, profile)
    costs = F.pandas_udf(lambda ks: ks.map(cost), "double")
    return spark.range(4, ENTRIES - 1).select(F.col("id").cast("int").alias("k")).withColumn("cost", costs("k"))


def best_fan_out(spark, n: int, memory: int, pressure: float, profile: dict[str, float]) -> DataFrame:
    """The k of least cost (ties: the smallest): one row, k and cost."""
    return fan_out_costs(spark, n, memory, pressure, profile).agg(F.min_by("k", F.struct("cost", "k")).alias("k"), F.min("cost").alias("cost"))


class Cascade:
    """Sorted levels in a folder, each `ratio` times the one above: a batch that overfills a level is
    merged into the next, where filters take back entries (on the last level for good)."""

    def __init__(self, spark, path: str, head: int, ratio: int, depth: int):
        self.spark, self.path, self.depth = spark, path.rstrip("/"), depth
        self.room = [head * ratio**i for i in range(depth)]
        self.files: list[str | None] = [None] * depth
        #: Entries of each level, merges into it since it was emptied last, and all merges into it.
        self.entries, self.merges, self.all_merges = [0] * depth, [0] * depth, [0] * depth
        self._writes = 0

    def _level(self, i: int) -> DataFrame:
        schema = "key long, ptr long, is_filter boolean"
        return self.spark.read.schema(schema).parquet(self.files[i]) if self.files[i] else self.spark.createDataFrame([], schema)

    def _set(self, i: int, rows: DataFrame | None) -> None:
        if rows is None:
            self.files[i], self.entries[i] = None, 0
            return
        path, self._writes = f"{self.path}/level{i}-{self._writes}", self._writes + 1
        bulkload(rows).write.parquet(path)
        self.files[i] = path
        self.entries[i] = self._level(i).count()

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (key, ptr, is_filter)."""
        self._set(0, run_merge(self._level(0), batch, lowest=self.depth == 1))
        i = 0
        while i + 1 < self.depth and self.entries[i] > self.room[i]:
            self._set(i + 1, run_merge(self._level(i + 1), self._level(i), lowest=i + 2 == self.depth))
            self._set(i, None)
            self.merges[i], self.merges[i + 1] = 0, self.merges[i + 1] + 1
            self.all_merges[i + 1] += 1
            i += 1

    def rows(self) -> DataFrame:
        """Live entries over all levels."""
        return compaction([self._level(i) for i in range(self.depth)])

    def levels(self) -> DataFrame:
        """level, entries, pages, merges, all_merges."""
        rows = [(i, n, -(-n // ENTRIES), m, a) for i, (n, m, a) in enumerate(zip(self.entries, self.merges, self.all_merges, strict=True))]
        return self.spark.createDataFrame(rows, "level int, entries long, pages long, merges int, all_merges int")


def key_membership(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_semi")


def prefix_membership(rows: DataFrame, prefixes: DataFrame, on: str) -> DataFrame:
    """Rows whose key starts with one of the prefixes: an equi-join for each prefix length, not a theta join."""
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).where("prefix is not null").distinct().collect())  # at most the longest prefix
    wide, flags = rows, []
    for n in lengths:
        cut, flag = f"__cut{n}", f"__has{n}"
        own = prefixes.where(F.length("prefix") == n).select(F.col("prefix").alias(cut), F.lit(True).alias(flag)).distinct()
        # At most one prefix of a length fits, so no row is doubled.
        wide = wide.withColumn(cut, F.when(F.length(on) >= n, F.substring(on, 1, n))).join(own, cut, "left").drop(cut)
        flags.append(F.coalesce(flag, F.lit(False)))
    return wide.where(functools.reduce(lambda a, b: a | b, flags, F.lit(False))).select(*rows.columns)
