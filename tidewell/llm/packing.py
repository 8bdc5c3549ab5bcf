"""Packing token sequences as a cutting-stock problem.

Documents are cut into full sequences and one remainder each.  Piece lengths, rounded
up to a grain, form a histogram of at most capacity/grain classes.  Column generation
solves the linear program over patterns (how many pieces of each class one sequence
takes): an unbounded knapsack by dynamic programming prices columns, a revised simplex
step takes the best in.  Multiplicities are rounded down and what is left is packed by
first fit on the histogram.  Pieces are ranked within their class and an allocation
table turns a rank into a sequence and a place.

Scale: the program's size depends on capacity and grain only, never on the corpus.
Pieces carry no ids through exchanges (about 48 bytes each).  Ranks come from counts by
(class, cell) and a window inside each cell, so a class with most pieces is spread.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch
from tidewell.llm.chunks import PartCache

#: Pieces of one size that a cell of ranks has, about.
CELL = 1 << 14
#: At most so many bytes of cells' counts are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 8 << 20
_encoders: dict[str, PartCache] = {}


class _Encoder(PartCache):
    """Encoder by a vocabulary file of library tokenizers.

    Latin text, which is most, is merged by tiktoken from the same file's vocabulary, the rest by
    tokenizers itself, which is loaded when a text first needs it.  Strings of special tokens in
    a text become those tokens, as the library has it; such a text is coded by it as a whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        super().__init__(self._part, limit=160_000)
        self.path = path
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = [t["content"] for t in described["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes() if text.isascii() or max(text) < "ɐ" else self._slow(text)

    def text(self, text: str) -> bytes:
        return self._slow(text) if self.special.search(text) else super().text(text)


def encoder(path: str) -> PartCache:
    """One encoder for each worker."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Cut each document's ids (and `end_id`): doc_id, start, length, ids_crc32, doc_tokens[, ids].

    `ids` adds the ids themselves as little-endian unsigned 32-bit integers.  Null text
    counts as empty: one piece with `end_id`.  Other columns are ignored.
    """
    end = array("I", [end_id]).tobytes()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = encoder(vocabulary)
        encode = parts.text
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = encode(text.as_py() or "") + end
                n = len(coded) // 4
                for at in range(0, n, capacity):
                    own = coded[4 * at : 4 * (at + capacity)]
                    for column, value in zip(out, (doc_id, at, len(own) // 4, zlib.crc32(own), n, own), strict=False):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        parts.clear()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidied(run), ddl)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value and how many of each size reach it."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_, duals_ = sizes[order], duals[order]
    fit = np.searchsorted(sizes_, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if fit[w]:
            values = best[w - sizes_[: fit[w]]] + duals_[: fit[w]]
            k = int(values.argmax())
            if values[k] > best[w] + 1e-12:
                best[w], took[w] = values[k], k
    counts, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            counts[order[took[w]]] += 1
            w -= int(sizes_[took[w]])
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 2e-3, most_steps: int = 1500) -> list[tuple[int, dict[int, int]]]:
    """Return (multiplicity, pieces by size) so that the patterns' pieces are exactly the demand.

    Columns are generated until the linear program is within `gap` of its lower bound.
    Prices are smoothed towards those of the best bound, which saves most steps.  Sums are
    elementwise: the matrices are small, and threads of a linear algebra library would fight
    with the driver's.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    d = np.array([demand[int(s)] for s in sizes], dtype=np.float64)
    columns = [np.where(np.arange(len(sizes)) == i, capacity // s, 0) for i, s in enumerate(sizes)]
    inverse = np.diag([1 / c[i] for i, c in enumerate(columns)])
    x = (inverse * d).sum(axis=1)
    steady, bound = sizes / capacity, (sizes * d).sum() / capacity
    for _ in range(most_steps):
        duals = inverse.sum(axis=0)
        if x.sum() <= bound * (1 + gap):
            break
        for weight in (0.9, 0.0):
            smooth = np.maximum(weight * steady + (1 - weight) * duals, 0)
            value, column = price(smooth, sizes, capacity)
            if (found := (smooth * d).sum() / max(value, 1)) > bound:
                bound, steady = found, smooth / max(value, 1)
            if (duals * column).sum() > 1 + 1e-9:
                break
        else:
            break
        direction = (inverse * column).sum(axis=1)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out] = column
        x = np.maximum((inverse * d).sum(axis=1), 0)
    left, plan = {int(s): int(demand[int(s)]) for s in sizes}, []
    for column, times in zip(columns, np.floor(x + 1e-6), strict=True):
        pattern = {int(s): int(n) for s, n in zip(sizes, column, strict=True) if n}
        times = min([int(times), *(left[s] // n for s, n in pattern.items())])
        if times > 0:
            plan.append((times, pattern))
            for s, n in pattern.items():
                left[s] -= times * n
    while any(left.values()):
        room, pattern = capacity, {}
        for s in reversed(sizes.tolist()):
            if n := min(left[s], room // s):
                pattern[s] = n
                room -= n * s
        times = min(left[s] // n for s, n in pattern.items())
        plan.append((times, pattern))
        for s, n in pattern.items():
            left[s] -= times * n
    return plan


def layout(cut: DataFrame, capacity: int = 1024, grain: int = 8) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length and any more columns).

    A piece's rank in its class goes by its cell, doc_id and start; equal rows are ranked
    in some order.  No pieces: an empty result.
    """
    spark = cut.sparkSession
    names = cut.columns
    units = (capacity + grain - 1) // grain
    size = F.ceil(F.col("length") / F.lit(grain)).cast("int")
    cut = scratch.written(cut.withColumn("__size", size), "pack-pieces")
    demand = {r[0]: r[1] for r in cut.groupBy("__size").count().collect()}  # at most capacity / grain rows
    if not demand:
        return cut.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = F.create_map(*[F.lit(x) for s, n in demand.items() for x in (s, -(-n // CELL))])
    cut = cut.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(parts, F.col("__size"))))
    counts = scratch.written(cut.groupBy("__size", "__cell").agg(F.count(F.lit(1)).alias("__n")), "pack-counts")
    rows, base = [], 0
    given = dict.fromkeys(demand, 0)
    # A grain that does not divide the capacity would let rounded full pieces overflow; they go alone.
    for times, pattern in cutting_stock(demand, units):
        for s, n in pattern.items():
            rows.append((s, given[s], given[s] + times * n, base, n))
            given[s] += times * n
        base += times
    before = Window.partitionBy("__size").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__size", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__size", "__cell").orderBy("doc_id", "start")
    ranked = cut.withColumn("__row", F.row_number().over(own) - 1)
    # A row for each CELL pieces and each size.
    ranked = ranked.join(F.broadcast(starts) if scratch.size(counts) <= BROADCAST_BYTES else starts, ["__size", "__cell"]).withColumn("__rank", F.col("__start") + F.col("__row"))
    table = F.broadcast(spark.createDataFrame(rows, "__size int, __from long, __to long, __base long, __each long"))
    fits = (ranked["__size"] == table["__size"]) & (ranked["__rank"] >= table["__from"]) & (ranked["__rank"] < table["__to"])
    index = F.col("__rank") - F.col("__from")
    placed = ranked.join(table, fits).select(
        *[ranked[n] for n in names], ranked["__size"], (F.col("__base") + F.call_function("div", index, F.col("__each"))).alias("sequence_id"), (index % F.col("__each")).alias("__place")
    )
    order = Window.partitionBy("sequence_id").orderBy(F.col("__size").desc(), "__place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, grain: int = 8, end_id: int = 0) -> DataFrame:
    """Cut and place all documents; see `pieces` and `layout`."""
    return layout(pieces(docs, vocabulary, capacity, end_id), capacity, grain)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 1024, grain: int = 8, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), length."""
    placed = layout(pieces(docs, vocabulary, capacity, end_id, ids=True), capacity, grain)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
