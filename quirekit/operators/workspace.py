"""The data model's operations in one place, over files and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as fx
from ..schemas import DONE, MAX_SEGMENT
from ..session import written
from ..sources import archives, epub, files, sinks
from . import checks, segment, translate


def inspect_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files with format and, for texts, decoded contents; bad ones with an error."""
    found = files.with_format(files.read_files(spark, path, pattern))
    texts = files.decode_texts(found.filter("source_format = 'txt'").drop("source_format")).withColumn("source_format", F.lit("txt"))
    rest = found.filter("source_format is null or source_format <> 'txt'")
    return texts.unionByName(rest.drop("content"), allowMissingColumns=True)


def extract_segments(documents: DataFrame, options: dict | None = None, limit: int = MAX_SEGMENT) -> DataFrame:
    """Units of decoded texts, numbered by order. ``key`` names the document: its path, where there is one, so that equal files stay apart."""
    key = "path" if "path" in documents.columns else "source_sha256"
    return segment.segment_texts(documents.filter("error is null").select(F.col(key).alias("key"), "text"), "key", options, limit)


def _refuse(wrong: DataFrame, code: str, what: str) -> None:
    found = wrong.limit(5).collect()
    if found:
        raise ValueError(f"{code}: {what}: {[tuple(r) for r in found]}")


def translate_segments(segments: DataFrame, factory: Callable[[], object] = translate.MockProvider, selected: DataFrame | None = None, existing: DataFrame | None = None, options: dict | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of all segments, and the status of the selected ones by document.

    The records are written (to ``folder``, else the shared one) before anything reads them, so a provider is asked once a distinct id however
    often the records, the status or a rebuild are used."""
    _refuse(translate.repeated_ids(segments, "key"), "INVALID_FORMAT", "ids must be unique in a document")
    records = written(translate.translated(segments, factory, selected, existing, options), "records", folder)
    work = records.filter("chosen")
    status = work.groupBy("key").agg(translate.batch_status().alias("status"), F.count("*").alias("selected"), F.count_if(F.col("action") == "work").alias("worked"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("order"))).alias("first_error"))
    return records, status.withColumn("status", F.when(F.col("worked") == 0, "noop").otherwise(F.col("status")))


def changed_sources(manifest: DataFrame, documents: DataFrame, key: str = "path") -> DataFrame:
    """(key, difference) of sources that aren't those of the manifest: missing, or of another checksum or size."""
    had = manifest.select(key, F.col("source_sha256").alias("had_sha"), F.col("source_size").alias("had_size"))
    now = documents.select(key, "source_sha256", "source_size")
    both = had.join(now, key, "left")
    what = F.when(F.col("source_sha256").isNull(), "missing").when((F.col("source_sha256") != F.col("had_sha")) | (F.col("source_size") != F.col("had_size")), "changed")
    return both.withColumn("difference", what).filter("difference is not null").select(key, "difference")


def rebuild_documents(records: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(key, text, translated, preserved, output_sha256): texts with done units replaced, in one shuffle by document.

    A unit counts as translated where its value is a result, even one equal to the source. With ``segments``, the units as they are now, records
    of other sources or policies, or done without a text, are refused."""
    if segments is not None:
        _refuse(translate.rejected(segments, records.filter(F.col("status").isin(*DONE))), "SOURCE_MISMATCH", "records don't fit the segments")
    taken = F.count_if(checks.taken(F.col("status"), F.col("translated_text")))
    valued = records.withColumn("value", checks.value_of(F.col("status"), F.col("translated_text"), F.col("source_text")))
    out = checks.rebuilt(valued, "key", "value", taken.alias("translated"), (F.count("*") - taken).alias("preserved"))
    return out.withColumn("output_sha256", ids.sha_text(F.col("text")))


def translate_documents(spark: SparkSession, path: str, target: str, factory: Callable[[], object] = translate.MockProvider, options: dict | None = None, pattern: str | None = None, selected: DataFrame | None = None, existing: DataFrame | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """Text files from source to result in one call: inspected, segmented, translated, rebuilt and written to the table ``target``.

    Returns the manifest, the segments, the records, the status by document, what was built, and what was left out: bad files with their error, and
    packages and pages, which ``sources.epub`` and ``sources.archives`` read.
    The sources are read again before the result is written: a file that changed meanwhile is refused."""
    sinks.require_apart(path, target)
    found = inspect_documents(spark, path, pattern)
    manifest = written(found, "manifest")
    segments = written(extract_segments(manifest.filter("source_format = 'txt'"), options), "segments")
    records, status = translate_segments(segments, factory, selected, existing, options)
    now = files.read_files(spark, path, pattern)
    _refuse(changed_sources(manifest, now), "SOURCE_MISMATCH", "sources changed")
    sinks.write_table(rebuild_documents(records, segments), target, overwrite)
    return {"manifest": manifest, "segments": segments, "records": records, "status": status, "built": spark.read.parquet(target), "left_out": left_out(manifest)}


def left_out(manifest: DataFrame) -> DataFrame:
    """(path, source_format, code) of files that a text run doesn't take: their error's code, or UNSUPPORTED_FORMAT."""
    code = F.coalesce("error.code", F.when(~F.col("source_format").eqNullSafe("txt"), "UNSUPPORTED_FORMAT"))
    return manifest.select("path", "source_format", code.alias("code")).filter("code is not null")


def unmatched_pages(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_sha256, order, difference) of pages without a payload, payloads without a page, and orders taken twice: none, if both fit one to one."""
    listed = manifest.groupBy("source_sha256", "order").agg(F.count("*").alias("listed"))
    held = pages.groupBy("source_sha256", "order").agg(F.count("*").alias("held"))
    what = F.when(F.col("held").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when((F.col("held") > 1) | (F.col("listed") > 1), "repeated")
    both = listed.join(held, ["source_sha256", "order"], "full_outer").withColumn("difference", what)
    return both.filter("difference is not null").select("source_sha256", "order", "difference")


def translate_pages(pages: DataFrame, factory: Callable[[], object], options: dict | None = None, protected: tuple[bytes, ...] = (), sleep: bool = True) -> DataFrame:
    """Pages through a page adapter with ``translate_image(bytes, name, options) -> bytes``: status, attempts and error of each.

    Bounded retries with growing pauses, as for texts; an output that is no image, or holds a protected value, is a failure. An adapter that
    says it is unhealthy (``health()`` other than "ok") is asked for nothing."""
    import time

    import pandas as pd

    from ..session import shipped

    shipped(pages.sparkSession)
    policy = translate.OPTIONS | (options or {})

    def one(adapter, body: bytes, name: str) -> tuple:
        attempt = 0
        while True:
            attempt += 1
            try:
                made = adapter.translate_image(body, name, policy)
                if archives.image_type(made) is None:
                    raise translate.ProviderError("OUTPUT_MISSING", "the adapter returned no image", True)
                if any(p and p in made for p in protected):
                    raise translate.ProviderError("OUTPUT_INVALID", "the output holds a protected value")
                return made, "succeeded", attempt, None, None
            except Exception as e:  # noqa: BLE001  any adapter error becomes the row's error
                known = isinstance(e, translate.ProviderError)
                if known and e.retryable and attempt <= policy["max_retries"]:
                    if sleep:
                        time.sleep(min(policy["retry_backoff_seconds"] * 2 ** (attempt - 1), 10.0))
                    continue
                return None, "failed", attempt, e.code if known else type(e).__name__, str(e) if known else None

    def run(frames):
        adapter = factory()
        state = adapter.health() if hasattr(adapter, "health") else "ok"
        for frame in frames:
            out = [one(adapter, bytes(body), name) if state == "ok" else (None, "failed", 0, "ADAPTER_UNAVAILABLE", str(state)) for body, name in zip(frame["content"], frame["name"], strict=True)]
            new = pd.DataFrame(out, columns=["content", "status", "attempts", "error_code", "error_message"])
            yield pd.concat([frame[["source_sha256", "order", "name", "page_id"]].reset_index(drop=True), new], axis=1)

    fine = pages.filter("error_code is null").select("source_sha256", "order", "name", "page_id", "content")
    return fine.mapInPandas(run, "source_sha256 string, `order` int, name string, page_id string, content binary, status string, attempts int, error_code string, error_message string")


class EchoAdapter:
    """Deterministic page adapter: gives each page back."""

    id = "mock-page"

    def translate_image(self, image: bytes, name: str, options: dict) -> bytes:
        return image


def page_status(results: DataFrame) -> DataFrame:
    return results.groupBy("source_sha256").agg(translate.page_status().alias("status"), F.count_if(F.col("status") == "succeeded").alias("translated"), F.count_if(F.col("status") != "succeeded").alias("omitted"))


inspect_epub, build_translated_epub = epub.epub_units, epub.rebuild_packages
inspect_pages, extract_pages, build_page_output = archives.pages, archives.verified_pages, archives.build_archives
output_name = fx.artifact_stem
