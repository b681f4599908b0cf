"""Content-addressed identities: sha256 over NUL-joined parts or canonical JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TXT_VERSION, EPUB_VERSION, PAGE_VERSION = "txt-segmentation.v1", "epub-visible-text.v1", "manga-page.v1"
NUL = "\x00"


def sha_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def joined(*parts: Column) -> Column:
    """sha256 of the parts with NUL between them; the parts must not be null."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        pieces += [F.lit(NUL), p] if i else [p]
    return sha_text(F.concat(*pieces))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def txt_segment_id(source_sha: Column, start: Column, end: Column, source_hash: Column) -> Column:
    return joined(F.lit("txt"), F.lit(TXT_VERSION), source_sha, F.concat(start.cast("string"), F.lit(":"), end.cast("string")), source_hash)


def epub_segment_id(kind: Column, source_sha: Column, locator_key: Column, source_hash: Column) -> Column:
    return joined(kind, F.lit(EPUB_VERSION), source_sha, locator_key, source_hash)


def page_id(source_sha: Column, name: Column, page_sha: Column) -> Column:
    return joined(F.lit(PAGE_VERSION), source_sha, name, page_sha)


def input_hash(segment_id: Column, source_hash: Column, options: dict) -> Column:
    """Hash of everything a translation depends on. Parameters are serialised on the driver and spliced in as text."""
    parameters = json.dumps(options.get("model_parameters", {}), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    rest = canonical_json(
        {
            "prompt_template": F.lit(options["prompt_template"]),
            "prompt_version": F.lit(options.get("prompt_version", "v1")),
            "segment_id": segment_id,
            "source_hash": source_hash,
            "source_language": F.lit(options.get("source_language", "auto")),
            "style": F.lit(options.get("style", "")),
            "target_language": F.lit(options.get("target_language", "en")),
        }
    )
    return sha_text(F.concat(F.lit('{"model_parameters":' + parameters + ","), F.substring(rest, 2, 1 << 30)))


def runtime_hash(core: Column, provider: str, model: str | None, context: str, endpoint: str | None, version: str = "runtime-translation-input.v1") -> Column:
    fields = {"schema_version": F.lit(version), "core_input_hash": core, "provider_id": F.lit(provider), "model": F.lit(model).cast("string"), "context_strategy": F.lit(context), "provider_endpoint": F.lit(endpoint).cast("string")}
    return sha_text(canonical_json(fields))


def segment_key(source_sha: Column, sequence: Column, source_hash: Column, locator_json: Column | None = None) -> Column:
    """Key of a persisted segment: its locator where it has one, else its sequence. ``locator_json`` is canonical JSON text or null."""
    place = F.coalesce(locator_json, sequence.cast("string")) if locator_json is not None else sequence.cast("string")
    rest = canonical_json({"schema_version": F.lit("runtime-segment-key.v1"), "source_checksum": source_sha, "source_hash": source_hash})
    return sha_text(F.concat(F.lit('{"location":'), place, F.lit(","), F.substring(rest, 2, 1 << 30)))
