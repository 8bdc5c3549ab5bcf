"""Stores of encoded values and of offsets, as tables in a folder that a later process can open again."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import codecs
from tidewell.sources import folders
from tidewell.sources.tiers import assign_pk, last_of

#: Fixed numbers of the five encodings.
PACKED, COMPRESSED, USER, USER_COMPRESSED, PACKED_INT = 1, 2, 3, 4, 5
#: How a value is put and got: (encode, decode) on columns.
Translator = tuple[Callable[[Column], Column], Callable[[Column], Column]]


class ValueStore:
    """Values by ordinal, in the encoding that the store was made with.

    Packed values keep their length with them, those of the user modes leave it to the caller
    (who may ask for the first `size` bytes); compressed ones pass through zlib; packed integers
    are zigzag varints.  A store that is there keeps its mode and level, whatever is asked for.
    """

    def __init__(self, spark: SparkSession, path: str, mode: int = PACKED, level: int = zlib.Z_BEST_SPEED, translator: Translator | None = None):
        self.spark, self.path, self.translator = spark, path.rstrip("/"), translator
        header = f"{self.path}/header"
        if not folders.names(spark, self.path):
            if mode not in (PACKED, COMPRESSED, USER, USER_COMPRESSED, PACKED_INT):
                raise ValueError(f"{mode} is no encoding")
            folders.write_json(spark, header, {"mode": mode, "level": level})
        found = folders.read_json(spark, header)
        self.mode, self.level = found["mode"], found["level"]

    def _parts(self) -> list[str]:
        return [f"{self.path}/{n}" for n in folders.names(self.spark, self.path) if n.startswith("part")]

    def _stored(self) -> DataFrame:
        schema = "ordinal long, data binary"
        return self.spark.read.schema(schema).parquet(*parts) if (parts := self._parts()) else self.spark.createDataFrame([], schema)

    def count(self) -> int:
        return self._stored().count()

    def append(self, values: DataFrame, order: list[str]) -> tuple[int, int]:
        """Append column `value` in an order without ties; return the first ordinal and the one after the last."""
        value = self.translator[0](F.col("value")) if self.translator else F.col("value")
        if self.mode == PACKED_INT:
            data = codecs.varint_encode(value)
        else:
            data = codecs.zlib_compressor(self.level)(value) if self.mode in (COMPRESSED, USER_COMPRESSED) else value
            if self.mode != USER:
                data = F.concat(codecs.varint_encode(F.octet_length(data).cast("long")), data)
        first = self._stored().agg(F.max("ordinal")).first()[0]
        first = 0 if first is None else first + 1
        path = f"{self.path}/part-{first:015d}-{uuid.uuid4().hex}"
        numbered = assign_pk(values.select("value", *[c for c in order if c != "value"]), "ordinal", first - 1, order)
        numbered.select("ordinal", data.alias("data")).write.parquet(path)
        return first, first + self.spark.read.parquet(path).count()

    def get(self, ordinals: list[int] | None = None, size: int | None = None) -> DataFrame:
        """ordinal, value of some ordinals, or of all; in mode USER the first `size` bytes."""
        rows = self._stored() if ordinals is None else self._stored().where(F.col("ordinal").isin(ordinals))
        data = F.col("data")
        if self.mode == PACKED_INT:
            value = codecs.varint_decode(data)
        else:
            if self.mode != USER:
                head = codecs.varint_size(data)
                data = F.substring(data, head + 1, F.octet_length(data) - head)
            elif size is not None:
                data = F.substring(data, F.lit(1), F.lit(size))
            value = codecs.zlib_decompress(data) if self.mode in (COMPRESSED, USER_COMPRESSED) else data
        return rows.select("ordinal", (self.translator[1](value) if self.translator else value).alias("value"))


class OffsetArray:
    """Offsets by ordinal.  Deleted entries stay, with offset 0; the latest of several changes holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        return [n for n in folders.names(self.spark, self.path) if n[0] == "c"]

    def rows(self) -> DataFrame:
        """ordinal, offset of all entries."""
        schema, found = "ordinal long, offset long, change long", self._names()
        if not found:
            return self.spark.createDataFrame([], schema).drop("change")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in found])
        return rows.groupBy("ordinal").agg(F.max_by("offset", "change").alias("offset"))

    def _change(self, rows: DataFrame) -> None:
        n = len(self._names())
        rows.select(F.col("ordinal").cast("long"), F.col("offset").cast("long"), F.lit(n).cast("long").alias("change")).write.parquet(f"{self.path}/c{n:012d}")

    def append(self, offsets: DataFrame, order: list[str]) -> None:
        """Add column `offset` at the end, in an order without ties."""
        last = self.rows().agg(F.max("ordinal")).first()[0]
        self._change(assign_pk(offsets, "ordinal", -1 if last is None else last, order))

    def update(self, changes: DataFrame) -> None:
        """Set (ordinal, offset) of entries that are there; others are left out."""
        known = self.rows().select("ordinal")
        self._change(last_of(changes.select("ordinal", "offset"), "ordinal").join(known, "ordinal", "left_semi"))

    def delete(self, ordinals: DataFrame) -> None:
        self.update(ordinals.select("ordinal", F.lit(0).cast("long").alias("offset")))

    def get(self, ordinal: int) -> int | None:
        row = self.rows().where(F.col("ordinal") == ordinal).first()
        return row and row["offset"]

    def count(self) -> int:
        """Entries, deleted ones too."""
        return self.rows().count()
