"""Table schemas, status values and fixed policies of the document data model."""

from __future__ import annotations

# Statuses, step weights, transitions and limits of the data model.
SOURCE, SUCCEEDED, MANUAL, FAILED, CANCELLED, PARTIAL, NOOP = "source", "succeeded", "manual", "failed", "cancelled", "partially_succeeded", "noop"
DONE = (SUCCEEDED, MANUAL)

PIPELINES = {
    "novel_txt_v1": (("detect_encoding", 0.08), ("extract_text", 0.07), ("segment_text", 0.15), ("translate_text", 0.50), ("quality_check", 0.10), ("export_novel", 0.10)),
    "novel_epub_v1": (("inspect_epub", 0.10), ("segment_epub", 0.20), ("translate_text", 0.50), ("quality_check", 0.10), ("export_epub", 0.10)),
    "manga_full_v1": (("prepare_manga", 0.15), ("translate_manga", 0.70), ("export_manga", 0.15)),
}

JOB_MOVES = {
    "queued": ("running", "paused", "cancelled"),
    "running": ("paused", "cancelling", "succeeded", "failed", "partially_succeeded"),
    "paused": ("queued", "cancelled"),
    "cancelling": ("cancelled", "failed"),
    "failed": ("queued",),
    "partially_succeeded": ("queued",),
    "succeeded": (),
    "cancelled": (),
}
STEP_MOVES = {
    "pending": ("running", "cancelled", "skipped"),
    "running": ("paused", "cancelling", "cancelled", "succeeded", "failed", "partially_succeeded"),
    "paused": ("pending", "cancelled"),
    "cancelling": ("cancelled", "failed"),
    "cancelled": ("pending",),
    "succeeded": ("pending",),
    "failed": ("pending",),
    "partially_succeeded": ("pending",),
    "skipped": ("pending",),
}
FINAL_JOB = ("cancelled", "succeeded", "failed", "partially_succeeded")

LIMITS = {"files": 2_000, "total_bytes": 1_048_576_000, "member_bytes": 104_857_600, "ratio": 100.0, "depth": 20}
MAX_SEGMENT, SLOT_MAX, MAX_SOURCE_BYTES = 1800, 1800, 100 * 1024 * 1024

SPAN = "struct<start:int,end:int>"
ERROR = "struct<code:string,message:string,details:string,retryable:boolean>"
LOCATOR = (
    "struct<kind:string,document_path:string,start:int,end:int,unit_sequence:int,element_index:int,slot:string,attribute:string,"
    "part_index:int,part_count:int,document_order:int,document_type:string>"
)
SEGMENTS = (
    f"source_sha256 string, segment_id string, `order` int, source_document string, source_text string, content_role string, locator {LOCATOR}, "
    "source_hash string, translation_input_hash string, joiner string, schema_version string"
)
RECORDS = (
    "source_sha256 string, segment_id string, `order` int, source_hash string, translation_input_hash string, status string, translated_text string, "
    f"provider_id string, model string, attempts int, usage map<string,bigint>, error {ERROR}"
)
#: Versions a reader accepts, by table.
VERSIONS = {
    "segment": "segment.v1",
    "manifest": "document-manifest.v1",
    "record": "translation-record.v1",
    "batch": "translation-batch.v1",
    "build": "build-result.v1",
    "pages": "manga-manifest.v1",
    "page_records": "manga-translation.v1",
}
