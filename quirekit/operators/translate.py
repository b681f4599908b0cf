"""Selection, precedence, retrying execution and batch status."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schemas import CANCELLED, DONE, ERROR, FAILED, MANUAL, NOOP, PARTIAL, SOURCE, SUCCEEDED
from ..session import shipped

# The default policy of a translation.
OPTIONS = {
    "source_language": "auto",
    "target_language": "en",
    "style": "",
    "prompt_template": "Translate from {source_language} to {target_language}. Style: {style}. Return only the translation.\n\n{text}",
    "prompt_version": "v1",
    "model_parameters": {},
    "max_retries": 2,
    "retry_backoff_seconds": 0.25,
}


class ProviderError(Exception):
    """A provider's refusal; ``retryable`` ones are tried again."""

    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.retryable = code, retryable


class MockProvider:
    """Deterministic offline provider."""

    id, model = "mock", "mock-v1"

    def translate(self, text: str, options: dict) -> dict:
        if fx.FAIL_MARK in text:
            raise ProviderError("PROVIDER_FAILURE", "the text asks for a failure", True)
        return {"text": f"[{options['target_language']}] {text}", "model": self.model, "usage": {"input_characters": len(text)}}


def unknown_ids(ids: DataFrame, segments: DataFrame) -> DataFrame:
    """Ids, of a selection or of existing translations, that no segment has."""
    return ids.select("segment_id").distinct().join(segments.select("segment_id"), "segment_id", "left_anti")


def require_known(ids: DataFrame, segments: DataFrame, what: str) -> None:
    """Fails before any provider call where ``unknown_ids`` finds one; names at most ten."""
    wrong = [r[0] for r in unknown_ids(ids, segments).orderBy("segment_id").limit(10).collect()]
    if wrong:
        raise ValueError(f"SEGMENT_NOT_FOUND: {what} {wrong}")


def planned(segments: DataFrame, selected: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``segments`` with ``action``: keep an existing result, work, or pass the source through; and the kept text and status.

    No selection table means all, an empty one none. Done results win over everything; other existing ones stay where their
    segment isn't selected."""
    if selected is None:
        out = segments.withColumn("chosen", F.lit(True))
    else:
        marks = selected.select("segment_id").distinct().withColumn("chosen", F.lit(True))
        out = segments.join(marks, "segment_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    if existing is None:
        out = out.withColumn("kept_status", F.lit(None).cast("string")).withColumn("kept_text", F.lit(None).cast("string"))
    else:
        # One result an id: done ones first, else the last by status and text.
        rank = F.struct(F.col("status").isin(*DONE).alias("done"), "status", "translated_text")
        had = existing.groupBy("segment_id").agg(F.max(rank).alias("kept")).select("segment_id", F.col("kept.status").alias("kept_status"), F.col("kept.translated_text").alias("kept_text"))
        out = out.join(had, "segment_id", "left")
    keep = F.col("kept_status").isin(*DONE) | (F.col("kept_status").isNotNull() & ~F.col("chosen"))
    return out.withColumn("action", F.when(F.coalesce(keep, F.lit(False)), "keep").when(F.col("chosen"), "work").otherwise(SOURCE))


def called(provider, text: str, policy: dict, protected: tuple[str, ...] = (), sleep: bool = True, note: Callable[[str, int, dict | None], None] = lambda kind, attempt, error: None) -> dict:
    """One text through a provider, with bounded retries and growing pauses: a record's values. ``note`` hears of each retry and of the end."""
    attempt = 0
    while True:
        attempt += 1
        try:
            answer = provider.translate(text, policy)
            body = answer.get("text")
            if not isinstance(body, str) or not body.strip():
                raise ProviderError("OUTPUT_MISSING", "the provider returned no text", True)
            if any(p and p in body for p in protected):
                raise ProviderError("OUTPUT_INVALID", "the output repeats a protected value")
            usage = {k: int(v) for k, v in (answer.get("usage") or {}).items() if isinstance(v, int) and not isinstance(v, bool) and v >= 0}
            note(SUCCEEDED, attempt, None)
            return {"status": SUCCEEDED, "translated_text": body, "model": answer.get("model"), "attempts": attempt, "usage": usage, "error": None}
        except Exception as e:  # noqa: BLE001  any provider error becomes the row's error
            known = isinstance(e, ProviderError)
            error = {"code": e.code if known else "PROVIDER_FAILURE", "message": str(e) if known else type(e).__name__, "details": "{}", "retryable": bool(known and e.retryable)}
            if known and e.retryable and attempt <= policy["max_retries"]:
                note("retry", attempt, error)
                if sleep:
                    time.sleep(min(policy["retry_backoff_seconds"] * 2 ** (attempt - 1), 10.0))
                continue
            ended = CANCELLED if error["code"] == "CANCELLED" else FAILED
            note(ended, attempt, error)
            return {"status": FAILED, "translated_text": None, "model": None, "attempts": attempt, "usage": {}, "error": error}


def executed(work: DataFrame, factory: Callable[[], object], options: dict | None = None, protected: tuple[str, ...] = (), sleep: bool = True) -> DataFrame:
    """Results of a provider over ``work`` (segment_id, source_text): status, text, provider, model, attempts, usage, error.

    One provider a partition; retries happen here, bounded, with growing pauses, so that a failing row never fails its task."""
    policy = OPTIONS | (options or {})
    shipped(work.sparkSession)

    def run(frames):
        provider = factory()
        for frame in frames:
            rows = [{"segment_id": k, "provider_id": getattr(provider, "id", ""), **called(provider, t, policy, protected, sleep)} for k, t in zip(frame["segment_id"], frame["source_text"], strict=True)]
            yield pd.DataFrame(rows, columns=["segment_id", "status", "translated_text", "provider_id", "model", "attempts", "usage", "error"])

    schema = f"segment_id string, status string, translated_text string, provider_id string, model string, attempts int, usage map<string,bigint>, error {ERROR}"
    return work.select("segment_id", "source_text").mapInPandas(run, schema)


def repeated_ids(segments: DataFrame, document: str | None = None) -> DataFrame:
    """(document, segment_id, n) of ids that several rows of one document have. Equal documents have equal ids, each once."""
    by = [document, "segment_id"] if document else ["segment_id"]
    return segments.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def translated(segments: DataFrame, factory: Callable[[], object] = MockProvider, selected: DataFrame | None = None, existing: DataFrame | None = None, options: dict | None = None, sleep: bool = True) -> DataFrame:
    """Records of all segments: kept, produced or passed through. Only work reaches the provider, each distinct id once; rows of equal ids
    (those of equal documents) share its result, so there are as many records as segments.

    The frame is lazy, and every action on it asks the provider anew: write it before reading it twice."""
    if selected is not None:
        require_known(selected, segments, "selected")
    if existing is not None:
        require_known(existing, segments, "existing")
    plan = planned(segments, selected, existing)
    work = plan.filter(F.col("action") == "work").dropDuplicates(["segment_id"])
    made = executed(work, factory, options, sleep=sleep)
    made = made.select("segment_id", F.struct(*[c for c in made.columns if c != "segment_id"]).alias("made"))
    working, keeping = F.col("action") == "work", F.col("action") == "keep"
    new = lambda c: F.when(working, F.col(f"made.{c}"))
    return plan.join(made, "segment_id", "left").select(
        *[c for c in plan.columns if c not in ("kept_status", "kept_text")],
        new("status").when(keeping, F.col("kept_status")).otherwise(SOURCE).alias("status"),
        new("translated_text").otherwise(F.col("kept_text")).alias("translated_text"),
        new("provider_id").when(keeping & (F.col("kept_status") == MANUAL), "caller").alias("provider_id"),
        new("model").alias("model"),
        new("attempts").otherwise(0).alias("attempts"),
        new("usage").otherwise(F.create_map().cast("map<string,bigint>")).alias("usage"),
        new("error").alias("error"),
    )


def rejected(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(segment_id, code) of translations that must not be built in: of unknown segments, of another source or policy, or without a text.

    ``translations`` has segment_id, status, translated_text, source_hash and translation_input_hash; an empty source hash isn't compared."""
    own = segments.select("segment_id", F.col("source_hash").alias("own_hash"), F.col("translation_input_hash").alias("own_input")).dropDuplicates(["segment_id"])
    both = translations.join(own, "segment_id", "left")
    done = F.col("status").isin(*DONE)
    code = (
        F.when(F.col("own_hash").isNull(), "SEGMENT_NOT_FOUND")
        .when(done & (F.coalesce("source_hash", F.lit("")) != "") & (F.col("source_hash") != F.col("own_hash")), "SOURCE_MISMATCH")
        .when((F.col("status") == SUCCEEDED) & ~F.col("translation_input_hash").eqNullSafe(F.col("own_input")), "SOURCE_MISMATCH")
        .when(done & F.col("translated_text").isNull(), "INVALID_FORMAT")
    )
    return both.withColumn("code", code).filter("code is not null").select("segment_id", "code")


def batch_status(status: str = "status") -> Column:
    """Status of a batch of selected records, as an aggregate."""
    s = F.col(status)
    good, bad, gone, every = F.count_if(s.isin(*DONE)), F.count_if(s == FAILED), F.count_if(s == CANCELLED), F.count(F.lit(1))
    return (
        F.when(every == 0, NOOP).when(gone > 0, F.when(good > 0, PARTIAL).otherwise(CANCELLED)).when(bad == 0, SUCCEEDED).when(bad == every, FAILED).otherwise(PARTIAL)
    )


def page_status(status: str = "status", runtime: bool = False) -> Column:
    """Status of a batch of pages; the runtime form knows no cancelled batch."""
    s = F.col(status)
    good, bad, gone, every = F.count_if(s == SUCCEEDED), F.count_if(s == FAILED), F.count_if(s == CANCELLED), F.count(F.lit(1))
    out = F.when((good == every) & (every > 0), SUCCEEDED).when(good > 0, PARTIAL)
    return out.otherwise(FAILED) if runtime else out.when((gone > 0) & (bad == 0), CANCELLED).otherwise(FAILED)
