"""Payload stores on any file system that Hadoop and Arrow know: listing, exclusive creation, deletion by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shipped

#: Names of files that a writer hasn't finished begin so.
PENDING = (".", "_")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder, and the folder's path in it."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path, on the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = hadoop(spark, path)
    return store.exists(where)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file that isn't there, whole; false where another writer came first. A file system must create exclusively, as HDFS does; on a local
    one the file is linked to its name, which is."""
    store, where = hadoop(spark, path)
    if store.getScheme() == "file":
        from .sinks import publish

        try:
            publish(where.toUri().getPath(), text.encode())
        except FileExistsError:
            return False
        return True
    try:
        out = store.create(where, False)
    except Exception as e:  # noqa: BLE001  py4j wraps what Hadoop throws
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in one folder, sorted; none where it isn't there."""
    store, where = hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    store, where = hadoop(spark, path)
    store.delete(where, True)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(storage_key, size, modified, pending) of all files below a folder; keys are paths in it. Tasks list; contents aren't read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "storage_key string, size long, modified timestamp, pending boolean")
    store, where = hadoop(spark, folder)
    root = store.makeQualified(where).toString().rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*")
    key = F.substring("path", F.length(F.lit(_slashes(root))) + 1, F.length("path"))
    name = F.element_at(F.split("storage_key", "/"), -1)
    rows = reader.load(folder).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.select(key.alias("storage_key"), "size", "modified").withColumn("pending", F.substring(name, 1, 1).isin(*PENDING))


def _slashes(root: str) -> str:
    return "file:/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


def deleted(rows: DataFrame, folder: str) -> DataFrame:
    """(storage_key, outcome) of keys whose files tasks delete: ``deleted``, ``missing``, or the kind of error. Doing it again is harmless.

    A key that leads out of the folder is ``refused``."""
    shipped(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        for frame in frames:
            yield pd.DataFrame({"storage_key": frame["storage_key"], "outcome": [_gone(store, root, k) for k in frame["storage_key"]]})

    return rows.select("storage_key").mapInPandas(run, "storage_key string, outcome string")


def _gone(store: fs.FileSystem, root: str, key: str) -> str:
    if not key or key.startswith("/") or ".." in key.split("/"):
        return "refused"
    try:
        store.delete_file(f"{root.rstrip('/')}/{key}")
    except FileNotFoundError:
        return "missing"
    except OSError as e:
        return type(e).__name__
    return "deleted"
