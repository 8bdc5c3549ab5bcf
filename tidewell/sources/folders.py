"""Folders that driver and executors share, and small files in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folder that this process set itself, and its own folder below each root.
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "" not in _own:
        _own[""] = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(_own[""])
    return _own[""]


def located(spark: SparkSession, name: str):
    """The file system and the path object of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def own_folder(spark: SparkSession) -> str:
    """This process's folder below the root; its file system removes it when the JVM ends."""
    base, app = root(spark), spark.sparkContext.applicationId
    if _own.get(f"{base} {app}") is None:
        _own[f"{base} {app}"] = f"{base}/tidewell-{uuid.uuid4().hex[:12]}"
        fs, folder = located(spark, _own[f"{base} {app}"])
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return _own[f"{base} {app}"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def remove(spark: SparkSession, name: str) -> None:
    fs, path = located(spark, name)
    fs.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, path = located(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def read_json(spark: SparkSession, name: str):
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


def write_json(spark: SparkSession, name: str, value) -> bool:
    """Write a small file whole or not at all; False if one of that name was there first.

    This needs a file system whose rename is atomic and refuses to replace (HDFS, local).
    """
    folder, _, base = name.rpartition("/")
    fs, new = located(spark, f"{folder}/.{base}-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    done = not fs.exists(located(spark, name)[1]) and fs.rename(new, located(spark, name)[1])
    if not done:
        fs.delete(new, False)
    return done
