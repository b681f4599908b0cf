"""Versioned records: round trips of all kinds, upgrades, and problems as rows."""

import json

import pytest
from pyspark.sql import functions as F

from quirekit.sources import records

LOCATOR = {"kind": "txt-span", "document_path": "", "start": 0, "end": 5, "unit_sequence": None, "element_index": None, "slot": None, "attribute": None, "part_index": None, "part_count": None, "document_order": None, "document_type": None}
SEGMENT = {"schema_version": "segment.v1", "segment_id": "s1", "order": 0, "source_format": "txt", "source_document": "", "source_text": "Hällo", "content_role": "heading", "locator": LOCATOR, "source_hash": "h", "translation_input_hash": "i", "joiner": "\n"}
RECORD = {"schema_version": "translation-record.v1", "segment_id": "s1", "order": 3, "source_hash": "h", "translation_input_hash": "i", "status": "failed", "translated_text": None, "provider_id": "mock", "model": None, "attempts": 2, "usage": {"n": 4}, "error": {"code": "X", "message": "m", "details": "{}", "retryable": True}}
BUILD = {"schema_version": "build-result.v1", "source_format": "epub3", "output_sha256": "o", "output_size": 12, "translated_count": 1, "preserved_count": 2, "details": {"deep": [1, {"x": None}]}}
MANIFEST = {"schema_version": "document-manifest.v1", "source_format": "txt", "source_sha256": "s", "source_size": 5, "filename": None, "encoding": "utf-8", "encoding_confidence": 1.0, "newline": "lf", "segmentation_version": "txt-segmentation.v1", "metadata": {"a": 1}, "structure": None, "segments": [SEGMENT]}
BATCH = {"schema_version": "translation-batch.v1", "status": "failed", "source_sha256": "s", "selected_segment_ids": ["s1"], "records": [RECORD]}
PAGE = {"page_id": "p", "order": 0, "name": "1.png", "media_type": "image/png", "source_sha256": "s", "source_size": 9, "archive_member": "1.png"}
PAGES = {"schema_version": "manga-manifest.v1", "source_format": "cbz", "source_sha256": "s", "source_size": 99, "filename": "b.cbz", "pages": [PAGE]}
RESULT = {"page_id": "p", "order": 0, "name": "1.png", "status": "succeeded", "media_type": "image/png", "image_base64": "AA==", "image_size": 1, "attempts": 1, "raw_result": {"k": 1}, "logs": ["l"], "error": None}
MANGA = {"schema_version": "manga-translation.v1", "status": "succeeded", "adapter_id": "mock", "manifest": PAGES, "pages": [RESULT]}
WHOLE = {"schema_version": "document-translation.v1", "manifest": MANIFEST, "translations": BATCH, "build": BUILD}


def texts(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "n int, value string")


@pytest.mark.parametrize("record", [SEGMENT, RECORD, BUILD, MANIFEST, BATCH, PAGES, MANGA, WHOLE], ids=lambda r: r["schema_version"])
def test_round_trip(spark, record):
    version = record["schema_version"]
    rows = records.loaded(texts(spark, record), version)
    got = rows.select("problem", records.stored(version, rows).alias("value")).first()
    assert got["problem"] is None and json.loads(got["value"]) == record


def test_problems_are_rows(spark):
    odd = [None, "no json", "[1]", "7", SEGMENT | {"schema_version": "segment.v9"}, {k: v for k, v in SEGMENT.items() if k != "schema_version"}, {k: v for k, v in SEGMENT.items() if k != "order"}, SEGMENT | {"source_format": "pdf"}, SEGMENT | {"order": "x"}]
    fine = [SEGMENT | {"order": "12", "further": 1}, {k: v for k, v in SEGMENT.items() if k not in ("content_role", "joiner")}]
    got = records.loaded(texts(spark, *odd, *fine), "segment.v1").orderBy("n").collect()
    assert [r["problem"] and (r["problem"]["code"], r["problem"]["message"]) for r in got] == [("INVALID_FORMAT", "not a JSON object")] * 4 + [("SCHEMA_VERSION", "expected segment.v1")] * 2 + [("INVALID_FORMAT", f"field {f}") for f in ("order", "source_format", "order")] + [None, None]
    assert got[-2]["order"] == 12 and got[-1]["content_role"] == "body" and got[-1]["joiner"] == ""


def test_nested_records_have_their_versions(spark):
    wrong = [MANIFEST | {"segments": [SEGMENT, SEGMENT | {"schema_version": "segment.v2"}]}, MANIFEST | {"segments": "none"}, MANIFEST | {"segments": []}]
    got = records.loaded(texts(spark, *wrong), "document-manifest.v1").orderBy("n").collect()
    assert [r["problem"] and r["problem"]["message"] for r in got] == ["field segments", "field segments", None]


def test_older_versions_are_upgraded(spark):
    first = records.Reader((records.Field("id", "string", True), records.Field("format", "string", True), records.Field("sha", "string"), records.Field("size", "bigint", default=0)), lambda f: {"id": f["id"], "source_format": F.lower(f["format"]), "output_sha256": f["sha"], "output_size": f["size"]})
    second = records.Reader((records.Field("source_format", "string", True), records.Field("output_sha256", "string", True), records.Field("output_size", "bigint", True)), lambda f: {n: f[n] for n in ("source_format", "output_sha256", "output_size")} | {"translated_count": F.lit(0).cast("bigint"), "preserved_count": F.lit(0).cast("bigint"), "details": F.parse_json(F.lit("{}"))})
    older = {"build-result.v-1": first, "build-result.v0": second}
    rows = [{"schema_version": "build-result.v-1", "id": "x", "format": "TXT", "sha": "o"}, {"schema_version": "build-result.v0", "source_format": "cbz", "output_sha256": "p", "output_size": "8"}, BUILD, {"schema_version": "build-result.v0", "source_format": "cbz"}]
    got = records.loaded(texts(spark, *rows), "build-result.v1", older).orderBy("n").collect()
    assert [(r["source_format"], r["output_sha256"], r["output_size"], r["translated_count"]) for r in got[:3]] == [("txt", "o", 0, 0), ("cbz", "p", 8, 0), ("epub3", "o", 12, 1)]
    assert [r["problem"] and r["problem"]["message"] for r in got] == [None, None, None, "field output_sha256"]
