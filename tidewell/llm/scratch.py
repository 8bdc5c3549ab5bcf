"""Intermediate tables in the folder that driver and executors share; memory of Python workers.

All tables of a process lie in one folder that its file system removes when the JVM ends.
Tables written inside `collected` belong to whoever opened it, who alone removes them.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch for Python workers.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}
#: For each file that it makes, a local file system starts a process to set the file's mode; the raw one doesn't.
RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)
#: This process's folder below each root.
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "" not in _own:
        _own[""] = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(_own[""])
    return _own[""]


def _path(spark: SparkSession, name: str):
    """The file system and path of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def new_path(spark: SparkSession, name: str) -> str:
    """Return a fresh path below the process's folder."""
    base = root(spark)
    if base not in _own or _own.get(f"{base}:app") != spark.sparkContext.applicationId:
        _own[base], _own[f"{base}:app"] = f"{base}/tidewell-{uuid.uuid4().hex[:12]}", spark.sparkContext.applicationId
        fs, folder = _path(spark, _own[base])
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    path = f"{_own[base]}/{uuid.uuid4().hex[:12]}-{name}"
    if (owner := _owner.get()) is not None:
        owner.append(path)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, raw: bool = True) -> DataFrame:
    """Write `df` as Parquet and read it back: lineage is cut, lost executors cost nothing.

    Batches for Python workers are small meanwhile: each is held on both sides.  State stores
    can't be read through the raw local file system.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, BATCHES | (RAW if raw else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size(table: DataFrame) -> int:
    """Bytes of the files that `table` reads, as Spark's own statistics have them."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """Gather the paths of tables written inside."""
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables whose readers have ended."""
    while paths:
        fs, path = _path(spark, paths.pop())
        fs.delete(path, True)


def drop(table: DataFrame) -> None:
    """Remove a table that `written` made and no plan will read again."""
    remove(table.sparkSession, list({f.rsplit("/", 1)[0] for f in table.inputFiles()}))


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
    trim()


def shrink(spark: SparkSession) -> None:
    """Let the executors' JVMs give back free heap, which else stays at its largest beside Python's workers."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives its worker's free memory back to the system when it ends.

    Idle workers live on beside the next stage's; what they hold counts as the executor's.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidy
