"""SimHash near-dedup by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles.  Distinct
fingerprints are cut into distance/2 + 1 segments: two within the distance differ by at
most one bit in some segment.  A table by (segment, value) is probed with the Hamming ball
of radius one about each segment - the value itself and the value with one zero bit set,
which finds every pair from one side - and matches are verified on all 64 bits.

A bucket with over `HOT` fingerprints is not expanded into pairs.  Its members and those
that probe it emit instead the 64-bit ball of radius distance/2 about themselves: two that
share a point are within the distance, and two within it share a point, so linking each to
the least fingerprint at the point keeps every link's component.

Scale: copies collapse to one fingerprint before any link is sought; each fingerprint makes
a bounded number of rows; no bucket yields more than HOT times its probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import scratch
from tidewell.llm.components import components

HOT = 64


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, A-Z lower-cased; of all words if fewer."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    own = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in own], dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash; zero if there are no words."""
    return majority(shingle_hashes(text or "", size))


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits, each set if it is in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Return doc_id, fp for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidied(run), "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    n = distance // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _probe(fp: Column, at: int, width: int) -> Column:
    """The segment's value and the values with one zero bit set."""
    value = _value(fp, at, width)
    ones = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda m: value.bitwiseAND(m) == 0)
    return F.concat(F.array(value), F.transform(ones, lambda m: value.bitwiseOR(m)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """From distinct fingerprints (fp) return links (a, b) whose components are those of all pairs within the distance."""
    if distance % 2:
        raise ValueError("the distance must be even")
    fp = F.col("fp")
    cut = _segments(distance)
    table = fps.select("fp", F.posexplode(F.array(*[_value(fp, a, w) for a, w in cut])).alias("seg", "key"))
    probes = fps.select(F.col("fp").alias("probe"), F.posexplode(F.array(*[_probe(fp, a, w) for a, w in cut])).alias("seg", "keys"))
    probes = probes.select("probe", "seg", F.explode("keys").alias("key"))
    sizes = scratch.written(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "simhash-hot")
    pair = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance
    if sizes.isEmpty():
        return probes.join(table, ["seg", "key"]).where((F.col("probe") != F.col("fp")) & pair).select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    keys = sizes.select("seg", "key")
    cold = table.join(keys, ["seg", "key"], "left_anti")
    pairs = probes.join(cold, ["seg", "key"]).where((F.col("probe") != F.col("fp")) & pair).select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    near = scratch.written(probes.join(keys, ["seg", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct(), "simhash-near-hot")
    masks = [_signed(sum(1 << b for b in bits)) for k in range(distance // 2 + 1) for bits in combinations(range(64), k)]
    points = near.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    stars = points.join(least, "point").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """Return doc_id, fp, component_id (smallest doc_id that links reach) for each row.

    Texts without words have fingerprint zero and link like any other.  A null doc_id is
    never smallest unless alone (then null).  No rows: an empty result.
    """
    own = scratch.written(fingerprints(docs, size), "simhash-fps")
    fps = scratch.written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = scratch.written(components(links(fps.select("fp"), distance)), "simhash-roots").withColumnRenamed("node", "fp")
    linked = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")
