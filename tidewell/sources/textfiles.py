"""Text inputs: index entries, operation logs, device profiles, and generators of the first two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.tiers import assign_pk


def _lines(spark: SparkSession, path: str, number: str) -> DataFrame:
    """Lines that aren't blank, numbered from 0 by file name, place of the split in the file, and place in the split."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    return assign_pk(lines.where(F.trim("value") != ""), number, -1, ["file", "block", "line"]).select(number, "value")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of ``key ptr``, several to a line or one, as pos (their order), key, ptr."""
    pairs = _lines(spark, path, "line").select("line", F.posexplode(F.regexp_extract_all("value", F.lit(r"(\d+)[ ,\t]+(\d+)"), F.lit(0))).alias("at", "e"))
    return assign_pk(pairs, "pos", -1, ["line", "at"]).select(
        "pos", F.regexp_extract("e", r"^(\d+)", 1).cast("int").alias("key"), F.regexp_extract("e", r"(\d+)$", 1).cast("int").alias("ptr")
    )


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``s k``, ``i k p``, ``d k`` and ``u k p`` as seq, op, key, ptr."""
    part = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path, "seq").select("seq", part[0].alias("op"), F.try_element_at(part, F.lit(2)).cast("int").alias("key"), F.try_element_at(part, F.lit(3)).cast("int").alias("ptr"))


def read_profile(spark: SparkSession, path: str) -> dict[str, int]:
    """``name: value`` lines of a device profile; ``#`` starts a comment."""
    pair = r"^\s*([A-Za-z_ ]+?)\s*:\s*(\d+)"
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & F.col("value").rlike(pair))
    return {r[0]: int(r[1]) for r in rows.select(F.regexp_extract("value", pair, 1), F.regexp_extract("value", pair, 2)).collect()}


def generate_entries(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n entries with odd keys and payloads below 100."""
    return spark.range(n).select((F.col("id") * 2 + 1).cast("int").alias("key"), F.floor(F.rand(seed) * 100).cast("int").alias("ptr"))


def generate_oplog(spark: SparkSession, n: int, keys: int, search: float = 0.8, seed: int = 1) -> DataFrame:
    """n searches and inserts on odd keys."""
    key = (F.floor(F.rand(seed + 1) * keys) * 2 + 1).cast("int")
    op = F.when(F.rand(seed) < search, "s").otherwise("i")
    return spark.range(n).select(F.col("id").alias("seq"), op.alias("op"), key.alias("key"), F.floor(F.rand(seed + 2) * 100).cast("int").alias("ptr"))
