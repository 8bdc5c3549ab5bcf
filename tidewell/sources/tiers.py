"""Two-tier store: fresh rows in a hot tier, migrated rows in a columnar cold tier, read as one.

Every change appends: new rows as a numbered part of the hot tier, replaced and deleted keys as a
numbered mask that hides rows of older parts.  So a change costs what it changes, not what the
table holds.  `move` carries hot rows to the cold tier, `compact` applies masks for good.  A small
state file names parts and masks; a change writes new folders and then the next state file, so
readers see one state or the other.  Two writers are told apart by an atomic rename that refuses
to replace, which HDFS and local file systems have and plain object stores lack.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans.query import Select
from tidewell.plans.schema import Table
from tidewell.sources import folders

#: Number of the change that a stored row or mask came with.
CHANGE = "__change"


def union_tiers(cold: DataFrame, hot: DataFrame) -> DataFrame:
    return cold.unionByName(hot)


def last_of(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the one with the greatest `order`, else the greatest row by all columns."""
    whole = F.struct(*changes.columns)
    kept = F.max_by(whole, order) if order else F.max(whole)
    return changes.groupBy(F.col(key).alias("__key")).agg(kept.alias("__row")).select("__row.*")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `changes`, one for each key, and rows of `current` that none of them replaces."""
    changes = last_of(changes, key, order)
    return current.join(changes.select(key), key, "left_anti").select(*current.columns).unionByName(changes.select(*current.columns))


def delete_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti").select(*current.columns)


def assign_pk(rows: DataFrame, key: str, after: int, order: list[str]) -> DataFrame:
    """Number rows from `after` + 1 in order, nulls last: ranks inside range partitions plus the partitions' offsets.

    The partitions are written once, and offsets and ranks both come from what is written: Spark samples
    the borders anew for each plan and merges small partitions by its size, so two plans number differently.
    """
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_last() for c in order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranked = spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    path = folders.new_folder(spark, "numbered")
    ranked.write.parquet(path)
    local = spark.read.schema(ranked.schema).parquet(path)
    counts = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition.
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = local.join(F.broadcast(starts), "__part").withColumn(key, F.col("__start") + F.col("__at") + F.lit(after + 1))
    return numbered.drop("__part", "__at", "__n", "__start")


def split_smallest(hot: DataFrame, key: str, count: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the `count` smallest keys (0: all), and the rest."""
    if not count:
        return hot, hot.limit(0)
    edge = hot.select(key).orderBy(key).limit(count).agg(F.max(key).alias("__edge"))  # keys are unique
    marked = hot.join(F.broadcast(edge))
    return marked.where(F.col(key) <= F.col("__edge")).select(*hot.columns), marked.where(F.col(key) > F.col("__edge")).select(*hot.columns)


class TieredStore:
    """Declared tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self, table: type[Table]) -> dict:
        base = f"{self.path}/{table.name}/state"
        found = [v for v in folders.names(self.spark, base) if v[0] == "v"]
        return folders.read_json(self.spark, f"{base}/{found[-1]}") if found else {"version": 0, "change": 0, "last_pk": None, "hot": [], "cold": [], "masks": []}

    def _set(self, table: type[Table], state: dict) -> None:
        state = state | {"version": state["version"] + 1, "schema": table.schema().json()}
        if not folders.write_json(self.spark, f"{self.path}/{table.name}/state/v{state['version']:012d}", state):
            raise RuntimeError(f"{table.name} was changed by another writer")

    def _write(self, table: type[Table], kind: str, rows: DataFrame, change: int) -> str:
        path = f"{self.path}/{table.name}/{kind}-{uuid.uuid4().hex}"
        rows.withColumn(CHANGE, F.lit(change).cast("long")).write.parquet(path)
        return path

    def tables(self) -> DataFrame:
        """Names of the tables that the store holds: table_name."""
        found = [(n,) for n in folders.names(self.spark, self.path) if folders.names(self.spark, f"{self.path}/{n}/state")]
        return self.spark.createDataFrame(found, "table_name string")

    def bootstrap(self, *tables: type[Table]) -> None:
        """Make both tiers of tables that aren't there yet; ValueError if one is there with other fields."""
        for table in tables:
            state = self._state(table)
            if not state["version"]:
                self._set(table, state)
            elif state["schema"] != table.schema().json():
                raise ValueError(f"{table.name} is stored with other fields")

    def _tier(self, table: type[Table], state: dict, name: str) -> DataFrame:
        schema = table.schema().add(CHANGE, "long")
        if not state[name]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*state[name])
        if not state["masks"]:
            return rows
        pk = table.pk().name
        masks = self.spark.read.parquet(*state["masks"]).groupBy(F.col(pk).alias("__masked")).agg(F.max(CHANGE).alias("__until"))
        return rows.join(masks, (F.col(pk) == F.col("__masked")) & (F.col(CHANGE) < F.col("__until")), "left_anti")

    def tier(self, table: type[Table], name: str) -> DataFrame:
        """Live rows of the tier "hot" or "cold"."""
        return self._tier(table, self._state(table), name).drop(CHANGE)

    def read(self, table: type[Table]) -> DataFrame:
        state = self._state(table)
        return union_tiers(self._tier(table, state, "cold"), self._tier(table, state, "hot")).drop(CHANGE)

    def starting_with(self, table: type[Table]) -> Select:
        return Select(table, self.read)

    def _changed(self, table: type[Table], state: dict, rows: DataFrame | None, keys: DataFrame | None = None, replaces: bool = False) -> None:
        """Append a part of the hot tier, a mask of keys, or a part with a mask of its own keys (which spares it)."""
        state["change"] += 1
        pk = table.pk().name
        if rows is not None:
            path = self._write(table, "hot", rows.select(*table.fields), state["change"])
            part = self.spark.read.parquet(path)
            state["hot"].append(path)
            top = part.agg(F.max(pk)).first()[0]
            state["last_pk"] = max((k for k in (state["last_pk"], top) if k is not None), default=None)
            keys = part if replaces else keys
        if keys is not None:
            state["masks"].append(self._write(table, "mask", keys.select(pk).distinct(), state["change"]))
        self._set(table, state)

    def insert(self, table: type[Table], rows: DataFrame) -> None:
        """Append rows with new keys to the hot tier."""
        self._changed(table, self._state(table), rows)

    def put(self, table: type[Table], rows: DataFrame, order: str | None = None) -> None:
        """Insert rows, or replace those with their keys."""
        self._changed(table, self._state(table), last_of(rows, table.pk().name, order), replaces=True)

    def update(self, table: type[Table], changes: DataFrame, columns: str = "__set") -> None:
        """Set fields of rows that are there.  `changes` has the key, values, and in `columns` the names
        of the fields to set (array<string>); without it the fields whose value isn't null are set."""
        pk = table.pk().name
        new = changes.select(F.col(pk).alias("__pk"), F.struct(*[F.col(c) for c in table.fields if c in changes.columns and c != pk]).alias("__new"), *([F.col(columns).alias("__set")] if columns in changes.columns else []))

        def value(c: str):
            if c == pk or c not in changes.columns:
                return F.col(c)
            wanted = F.array_contains("__set", c) if columns in changes.columns else F.col(f"__new.{c}").isNotNull()
            return F.when(wanted, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)

        rows = self.read(table).join(new, F.col(pk) == F.col("__pk")).select(*[value(c) for c in table.fields])
        self._changed(table, self._state(table), rows, replaces=True)

    def save(self, table: type[Table], rows: list[dict]) -> list[dict]:
        """Insert rows, or set the dirty and non-null fields of those that were saved before; rows
        without a primary key get the next numbers."""
        pk, state = table.pk().name, self._state(table)
        last = -1 if state["last_pk"] is None else state["last_pk"]
        for row in rows:
            if row.get(pk) is None:
                last += 1
                dict.__setitem__(row, pk, last)
        known = [r for r in rows if getattr(r, "persisted", False)]
        fresh = [r for r in rows if not getattr(r, "persisted", False)]
        values = lambda r: tuple(r.get(k) for k in table.fields)
        if fresh:
            self.put(table, self.spark.createDataFrame([values(r) for r in fresh], table.schema()))
        if known:
            fields = [(*values(r), [k for k in table.fields if r.get(k) is not None or k in r.dirty]) for r in known]
            self.update(table, self.spark.createDataFrame(fields, table.schema().add("__set", T.ArrayType(T.StringType()))))
        for row in rows:
            if hasattr(row, "dirty"):
                row.persisted, row.dirty = True, {}
        return rows

    def delete(self, table: type[Table], keys: DataFrame) -> None:
        self._changed(table, self._state(table), None, keys)

    def move(self, table: type[Table], count: int = 0) -> None:
        """Migrate the rows with the `count` smallest keys (0: all) from hot to cold."""
        state = self._state(table)
        if not state["hot"]:
            return
        moved, rest = split_smallest(self._tier(table, state, "hot").drop(CHANGE), table.pk().name, count)
        state["change"] += 1
        state["cold"] = [*state["cold"], self._write(table, "cold", moved, state["change"])]
        state["hot"] = [self._write(table, "hot", rest, state["change"])] if count else []
        self._set(table, state)

    def compact(self, table: type[Table]) -> None:
        """Write both tiers anew without what masks hide."""
        state = self._state(table)
        if state["masks"]:
            state["change"] += 1
            tiers = {t: [self._write(table, t, self._tier(table, state, t).drop(CHANGE), state["change"])] if state[t] else [] for t in ("hot", "cold")}
            self._set(table, state | tiers | {"masks": []})

    def flush(self, *tables: type[Table]) -> None:
        for table in tables:
            self.move(table)

    def execute(self, sql: str, *tables: type[Table]) -> DataFrame:
        """Run SQL over the hot tiers of tables."""
        for table in tables:
            self.tier(table, "hot").createOrReplaceTempView(table.name)
        return self.spark.sql(sql)
