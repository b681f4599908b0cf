"""Sinks: guarded table writes, single files published atomically, content-addressed payloads, JSON rows."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shipped


def same_place(a: str, b: str) -> bool:
    """Whether two URIs name one file or folder, by path and, for local ones, by inode."""
    one, two = urlsplit(a), urlsplit(b)
    if (one.scheme or "file", one.netloc) != (two.scheme or "file", two.netloc):
        return False
    x, y = Path(one.path), Path(two.path)
    if (one.scheme or "file") != "file":
        return os.path.normpath(one.path) == os.path.normpath(two.path)
    return x.resolve() == y.resolve() or (x.exists() and y.exists() and os.path.samefile(x, y))


def require_apart(source: str, target: str) -> None:
    if same_place(source, target):
        raise ValueError("OUTPUT_CONFLICT: the output would replace its source")


def write_table(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> None:
    """Parquet through Spark's commit protocol: a partial write is never published."""
    require_apart_of = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in require_apart_of:
        require_apart(folder, path)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def publish(target: str, payload: bytes, overwrite: bool = False) -> None:
    """Writes one file beside its target and moves it there once it is whole."""
    path = Path(target)
    if path.exists() and not overwrite:
        raise FileExistsError(f"OUTPUT_CONFLICT: {target}")
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(payload)
            out.flush()
            os.fsync(out.fileno())
        if overwrite:
            os.replace(name, path)
        else:
            os.link(name, path)  # fails where another writer came first
            os.unlink(name)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def store_payloads(rows: DataFrame, folder: str, maximum: int) -> DataFrame:
    """(key, storage_key, size, checksum, error) of payloads (key, content), each written once under its checksum in a folder that all
    executors share. Running it again, or twice at once, gives the same files."""
    shipped(rows.sparkSession)

    def run(frames):
        for frame in frames:
            out = []
            for key, body in zip(frame["key"], frame["content"], strict=True):
                if body is None or len(body) > maximum:
                    out.append((key, None, None, None, "ARTIFACT_MISSING" if body is None else "UPLOAD_TOO_LARGE"))
                    continue
                digest = hashlib.sha256(body).hexdigest()
                path = f"{folder}/{digest[:2]}/{digest}"
                if not (os.path.exists(path) and os.path.getsize(path) == len(body)):
                    publish(path, bytes(body), overwrite=True)
                out.append((key, path, len(body), digest, None))
            yield pd.DataFrame(out, columns=["key", "storage_key", "size", "checksum", "error"]).astype({"size": "Int64"})

    return rows.select("key", "content").mapInPandas(run, f"key {dict(rows.dtypes)['key']}, storage_key string, size long, checksum string, error string")


def as_json(*columns: str | Column, binary: tuple[str, ...] = ()) -> Column:
    """A row as JSON with nulls kept; binary columns as base64."""
    fields = [F.base64(F.col(c)).alias(c) if c in binary else F.col(c) if isinstance(c, str) else c for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
