"""Versioned key/value table and free-extent management."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources import folders
from tidewell.sources.tiers import delete_keys, upsert


class IntegrityError(Exception):
    """A version's rows aren't those that its header was signed for."""


def checksum(rows: DataFrame) -> str:
    """SHA-256 over the rows' number and sums of their digests' words: equal for equal bags of rows, in one aggregation."""
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]), 256)
    words = [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    found = rows.agg(F.count(F.lit(1)), *[F.sum(w) for w in words]).first()
    return hashlib.sha256(",".join(str(x) for x in found).encode()).hexdigest()


class VersionedTable:
    """(key, value) rows in a folder, with staged changes, commit to a new version, and rollback to the last.

    A version has a signed header; `verify` raises IntegrityError where rows and header differ.
    """

    schema = "key long, value long"

    def __init__(self, spark: SparkSession, path: str, capacity: int | None = None):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        found = [int(n[6:]) for n in folders.names(spark, self.path) if n.startswith("header")]
        self.version = max(found, default=0)
        self.staged: DataFrame | None = None

    def _saved(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._saved() if self.staged is None else self.staged

    def put(self, changes: DataFrame, order: str | None = None) -> None:
        """Set keys; of changes with one key the greatest by `order` (else by value) holds.  OverflowError
        if the table would have more keys than its capacity."""
        staged = upsert(self.rows(), changes, "key", order)
        if self.capacity is not None and staged.count() > self.capacity:
            raise OverflowError(f"more than {self.capacity} keys")
        self.staged = staged

    def delete(self, keys: DataFrame) -> None:
        """Deleting a key that isn't there does nothing."""
        self.staged = delete_keys(self.rows(), keys, "key")

    def get(self, key: int) -> int | None:
        row = self.rows().where(F.col("key") == key).first()
        return row and row["value"]

    def commit(self) -> None:
        if self.staged is None:
            return
        path = f"{self.path}/v{self.version + 1}"
        self.staged.write.mode("overwrite").parquet(path)
        header = {"rows": path, "signature": checksum(self.spark.read.schema(self.schema).parquet(path))}
        if not folders.write_json(self.spark, f"{self.path}/header{self.version + 1}", header):
            raise RuntimeError(f"{self.path} was changed by another writer")
        self.version, self.staged = self.version + 1, None

    def rollback(self) -> None:
        self.staged = None

    def verify(self) -> None:
        if self.version and folders.read_json(self.spark, f"{self.path}/header{self.version}")["signature"] != checksum(self._saved()):
            raise IntegrityError(f"{self.path}, version {self.version}")

    def checksum(self) -> str:
        return checksum(self.rows())


def bucket_histogram(rows: DataFrame, bits: int) -> DataFrame:
    """Rows by their key's low bits."""
    return rows.groupBy(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def coalesce_extents(extents: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Union of half-open intervals: start, end, sorted and apart.

    Intervals are cut at block borders and merged inside each block; a second pass joins what
    touches across borders, so a long chain of intervals is spread over tasks.
    """
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    cut = extents.where("end > start").select("start", "end", F.explode(F.sequence(first, last)).alias("__b"))
    cut = cut.select("__b", F.greatest("start", F.col("__b") * block).alias("start"), F.least("end", (F.col("__b") + 1) * block).alias("end"))
    inside = _merge(cut, Window.partitionBy("__b").orderBy("start", "end"), ["__b"])
    touches = (F.col("start") == F.col("__b") * block) | (F.col("end") == (F.col("__b") + 1) * block)
    # Two rows a block at most touch a border.
    border = _merge(inside.where(touches).select("start", "end"), Window.orderBy("start", "end"), [])
    return inside.where(~touches).select("start", "end").unionByName(border)


def _merge(rows: DataFrame, order, keys: list[str]) -> DataFrame:
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    grouped = rows.withColumn("__new", new).withColumn("__g", F.sum("__new").over(order))
    return grouped.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def first_fit(extents: DataFrame, requests: DataFrame) -> DataFrame:
    """Serve (seq, count) requests in order from the lowest extent that fits: seq, start (null if none fits).

    Every answer depends on all before it, so this is one ordered fold over the coalesced list.
    """
    free = coalesce_extents(extents).select(F.lit(0).alias("what"), "start", "end", F.lit(0).cast("long").alias("seq"))
    asked = requests.select(F.lit(1).alias("what"), F.col("count").cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.col("seq").cast("long").alias("seq"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        starts, ends = (frame[frame.what == 0].sort_values("start")[c].to_list() for c in ("start", "end"))
        width = 1 << max(len(starts) - 1, 0).bit_length()
        most = [0] * width + [b - a for a, b in zip(starts, ends, strict=True)]  # a tree: the longest extent below each node
        most += [0] * (2 * width - len(most))
        for k in range(width - 1, 0, -1):
            most[k] = max(most[2 * k], most[2 * k + 1])
        out = []
        for seq, count in frame[frame.what == 1].sort_values("seq")[["seq", "start"]].itertuples(index=False):
            if most[1 if width > 1 else width] < count or not starts:
                out.append((seq, None))
                continue
            k = 1
            while k < width:
                k = 2 * k if most[2 * k] >= count else 2 * k + 1
            out.append((seq, starts[k - width]))
            starts[k - width] += count
            most[k] -= count
            while k > 1:
                k //= 2
                most[k] = max(most[2 * k], most[2 * k + 1])
        return pd.DataFrame({"seq": [o[0] for o in out], "start": pd.array([o[1] for o in out], dtype="Int64")})

    return free.unionByName(asked).groupBy(F.lit(0).alias("all")).applyInPandas(run, "seq long, start long")
