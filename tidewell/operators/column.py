"""Column analytics on (row_id, value): dictionary, runs, segments, folds, lookups.

Runs use gaps-and-islands windows inside fixed ranges of row ids, and a second pass joins those
that touch a range's border, so that one value with most rows is not one task's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.tiers import assign_pk

BLOCK = 1 << 20


def islands(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive row ids with one value: value, start, end."""
    part = rows.where("value is not null").select("row_id", "value", F.floor(F.col("row_id") / block).alias("__b"))
    order = Window.partitionBy("value", "__b").orderBy("row_id")
    local = part.withColumn("__i", F.col("row_id") - F.dense_rank().over(order))
    local = local.groupBy("value", "__b", "__i").agg(F.min("row_id").alias("start"), F.max("row_id").alias("end"))
    # At most a run at each border of a block goes on; these meet in a second pass, the rest is final.
    border = (F.pmod("start", F.lit(block)) == 0) | (F.pmod("end", F.lit(block)) == block - 1)
    over = Window.partitionBy("value").orderBy("start")
    new = F.coalesce((F.col("start") != F.lag("end").over(over) + 1).cast("int"), F.lit(1))
    met = local.where(border).withColumn("__g", F.sum(new).over(over)).groupBy("value", "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return local.where(~border).select("value", "start", "end").unionByName(met.select("value", "start", "end"))


def segments(rows: DataFrame) -> DataFrame:
    """Closed segments by value."""
    return islands(rows)


def rle_encode(rows: DataFrame) -> DataFrame:
    """Runs as value, start, extra (rows beyond the first)."""
    return islands(rows).select("value", "start", (F.col("end") - F.col("start")).alias("extra"))


def rle_decode(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence("start", F.col("start") + F.col("extra"))).alias("row_id"), "value")


def predicate_segments(rows: DataFrame, predicate: Column) -> DataFrame:
    """Segments whose value satisfies a predicate on column ``value``; order by value, start to list them."""
    return islands(rows.where(predicate))


def predicate_segments_udf(rows: DataFrame, predicate: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """The same for an arbitrary vectorised predicate, called once for each distinct value."""
    keep = F.pandas_udf(predicate, "boolean")
    values = rows.select("value").distinct().where(keep("value"))
    return islands(rows.join(values, "value", "left_semi"))


def dictionary_encode(rows: DataFrame) -> DataFrame:
    """Distinct values with their index in order of first row (ties by value): value, value_index."""
    first = rows.where("value is not null").groupBy("value").agg(F.min("row_id").alias("first_row"))
    return assign_pk(first, "value_index", -1, ["first_row", "value"]).select("value", F.col("value_index").cast("long"))


def value_frequency(rows: DataFrame) -> DataFrame:
    return rows.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def fold(rows: DataFrame, step: Callable, start=0.0) -> DataFrame:
    """Fold (value, accumulator, count) over distinct values in ascending order: one row, result.

    For folds that Spark has no aggregate for.  It runs in one task over the frequency table,
    in batches, so its cost is that of the distinct values, not of the rows.
    """

    def run(frames):
        total = start
        for frame in frames:
            for value, n in zip(frame["value"], frame["n"], strict=True):
                total = step(value, total, n)
        yield pd.DataFrame({"result": [float(total)]})

    return value_frequency(rows).orderBy("value").coalesce(1).mapInPandas(run, "result double")


def fold_sum(rows: DataFrame) -> DataFrame:
    """The sum, exact for integers and decimals (up to 38 digits), else as doubles add up; 0 of none."""
    kind = rows.schema["value"].dataType
    value = F.col("value").cast("decimal(28,0)") if isinstance(kind, T.IntegralType) else F.col("value")
    return rows.agg(F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("fold_sum"))


def fold_product(rows: DataFrame) -> DataFrame:
    """The product, 1 of none, over the frequency table: a value's powers are taken at once."""
    return value_frequency(rows).agg(F.coalesce(F.product(F.pow("value", "n")), F.lit(1.0)).alias("fold_product"))


def fold_min_max(rows: DataFrame) -> DataFrame:
    """Folds that start at zero: the least and the greatest of zero and the values."""
    return rows.agg(F.least(F.lit(0.0), F.min("value")).alias("fold_min"), F.greatest(F.lit(0.0), F.max("value")).alias("fold_max"))


def fold_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("value").alias("fold_count"))


def cell_latest(puts: DataFrame) -> DataFrame:
    """From (seq, row_id, value): the last value put in each row."""
    return puts.groupBy("row_id").agg(F.max_by("value", "seq").alias("value"))


def cell_smallest(puts: DataFrame) -> DataFrame:
    return puts.groupBy("row_id").agg(F.min("value").alias("value"))


def column_zip(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Put two columns of one table together by row id; a missing cell is null."""
    return left.withColumnRenamed("value", left_name).join(right.withColumnRenamed("value", right_name), "row_id", "full_outer")
