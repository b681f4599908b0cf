"""Files as rows: bounded binary reads, format sniffing, strict text decoding, versioned tables, checked payloads.

A bad file becomes a row with an ``error``; a corpus job never fails on it."""

from __future__ import annotations

import codecs
import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schemas import ERROR, MAX_SOURCE_BYTES
from ..session import shipped

# Starts of binary formats that a text file must not have.
SIGNATURES = (b"\x7fELF", b"7z\xbc\xaf\x27\x1c", b"%PDF-", b"BM", b"GIF87a", b"GIF89a", b"II*\0", b"MM\0*", b"PK\x03\x04", b"Rar!\x1a\x07", b"\x1f\x8b", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")


def error(code: str, message: str | Column, retryable: bool = False) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit("{}").alias("details"), F.lit(retryable).alias("retryable")).cast(ERROR)


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def _empty_paths(spark: SparkSession, path: str, pattern: str | None, recursive: bool) -> list[tuple[str]]:
    """Paths of files without a byte, which Spark's readers leave out."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    out, listing = [], store.listFiles(root, recursive)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if status.getLen() == 0 and not name.startswith(("_", ".")) and (pattern is None or fnmatch.fnmatchcase(name, pattern)):
            out.append((status.getPath().toString(),))
    return out


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, maximum: int = MAX_SOURCE_BYTES) -> DataFrame:
    """(path, filename, source_size, source_sha256, content, error): files over the limit come without content.

    The length filter reaches the scan, so contents over the limit are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    fine = files.filter(F.col("length") <= maximum).select("path", "length", "content", no_error().alias("error"))
    large = files.select("path", "length").filter(F.col("length") > maximum).select("path", "length", F.lit(None).cast("binary").alias("content"), error("UPLOAD_TOO_LARGE", "the file exceeds the size limit").alias("error"))
    found = fine.unionByName(large)
    empty = _empty_paths(spark, path, pattern, recursive)
    if empty:
        rows = spark.createDataFrame(empty, "path string")
        found = found.unionByName(rows.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"), no_error().alias("error")))
    return found.select("path", fx.basename(F.col("path")).alias("filename"), F.col("length").alias("source_size"), F.sha2("content", 256).alias("source_sha256"), "content", "error")


def with_format(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """``source_format``: the hint, else by suffix and first bytes; other archives get an error."""
    head = F.hex(F.substring("content", 1, 4))
    early = F.hex(F.substring("content", 1, 512))
    marked = F.contains(early, F.lit(b"application/epub+zip".hex().upper()))
    suffix = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    sniffed = (
        F.when((suffix == "epub") | ((head == "504B0304") & marked), "epub3")
        .when(suffix.isin("cbz", "zip") & (head == "504B0304"), "cbz")
        .when(suffix.isin(*fx.MEDIA), "image")
        .when(head == "504B0304", F.lit(None))
        .otherwise("txt")
    )
    named = F.coalesce(hint, sniffed) if hint is not None else sniffed
    out = files.withColumn("source_format", F.when(F.col("error").isNull(), named))
    return out.withColumn("error", F.when(F.col("error").isNull() & F.col("source_format").isNull(), error("INVALID_FORMAT", "the archive is of no known kind")).otherwise(F.col("error")))


def sniff_encoding(payload: bytes) -> tuple[str, float]:
    """Encoding of bytes by their mark, strict UTF-8, or the detector, and how sure it is; empty if unknown."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if payload.startswith(mark):
            return name, 1.0
    try:
        payload.decode("utf-8")
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:  # the detector is optional
        return "", 0.0
    best = from_bytes(payload).best()
    return (best.encoding, min(max(best.percent_coherence / 100, 0.0), 1.0)) if best and best.encoding else ("", 0.0)


def _decode_rest(frames):
    for frame in frames:
        rows = []
        for payload in frame["content"]:
            name, sure = sniff_encoding(payload)
            try:
                rows.append((payload.decode(name) if name else None, name or None, sure))
            except (LookupError, UnicodeDecodeError):
                rows.append((None, name, sure))
        yield pd.concat([frame[["path"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "encoding", "encoding_confidence"])], axis=1)


def decode_texts(files: DataFrame) -> DataFrame:
    """(path, filename, source_size, source_sha256, text, encoding, encoding_confidence, newline, error) of text files.

    Valid UTF-8 without a mark, the usual case, is decoded by built-in functions; only other files go to Python."""
    shipped(files.sparkSession)
    head = F.hex(F.substring("content", 1, 12))
    binary = F.lit(False)
    for s in SIGNATURES:
        binary = binary | head.startswith(s.hex().upper())
    binary = binary | (head.startswith(b"RIFF".hex().upper()) & (F.substring(head, 17, 8) == b"WEBP".hex().upper()))
    first = F.when(F.length("content") == 0, error("INVALID_FORMAT", "the text is empty")).when(binary, error("INVALID_FORMAT", "the file holds binary data"))
    checked = files.withColumn("error", F.coalesce("error", first))
    marked = head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF") | head.startswith("0000FEFF")
    plain = F.col("error").isNull() & F.is_valid_utf8(F.col("content").cast("string")) & ~marked
    checked = checked.withColumn("plain", F.coalesce(plain, F.lit(False)))
    fast = checked.filter("plain").withColumn("text", F.col("content").cast("string")).withColumn("encoding", F.lit("utf-8")).withColumn("encoding_confidence", F.lit(1.0))
    other = checked.filter("not plain and error is null")
    slow = other.drop("content").join(other.select("path", "content").mapInPandas(_decode_rest, "path string, text string, encoding string, encoding_confidence double"), "path")
    bad = checked.filter("not plain and error is not null").withColumn("text", F.lit(None).cast("string")).withColumn("encoding", F.lit(None).cast("string")).withColumn("encoding_confidence", F.lit(None).cast("double"))
    columns = ["path", "filename", "source_size", "source_sha256", "text", "encoding", "encoding_confidence", "error"]
    out = fast.select(*columns).unionByName(slow.select(*columns)).unionByName(bad.select(*columns))
    body = F.regexp_replace("text", "^﻿+", "")
    odd = F.regexp_count(body, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    late = (
        F.when(F.col("text").isNull(), error("INVALID_FORMAT", "the encoding could not be told"))
        .when(F.contains(body, F.lit("\x00")) | (odd > F.greatest(F.lit(8), F.floor(F.length(body) / 100))), error("INVALID_FORMAT", "the file holds binary data"))
        .when(fx.strip(body) == "", error("INVALID_FORMAT", "the file holds no text"))
    )
    out = out.withColumn("error", F.coalesce("error", late)).withColumn("newline", F.when(F.col("error").isNull(), fx.newline_style(body)))
    return out.withColumn("text", F.when(F.col("error").isNull(), fx.plain_newlines(F.col("text"))))


def checked_payloads(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts (storage_key, size, checksum) with their payloads; missing or altered ones come with an error."""
    found = files.select(F.col("path").alias("storage_key"), "content", F.col("source_size").alias("found_size"), F.col("source_sha256").alias("found_sha"))
    joined = artifacts.join(found, "storage_key", "left")
    wrong = F.when(F.col("found_size").isNull(), error("ARTIFACT_MISSING", "no payload")).when((F.col("found_size") != F.col("size")) | (F.col("found_sha") != F.col("checksum")), error("ARTIFACT_ALTERED", "size or checksum differ"))
    return joined.withColumn("error", wrong).withColumn("content", F.when(F.col("error").isNull(), F.col("content"))).drop("found_size", "found_sha")
