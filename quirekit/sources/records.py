"""Versioned records as JSON: one reader a version, upgrades on read, rows with a problem for all that can't be read.

A text is parsed once into a variant; its ``schema_version`` picks the reader. A reader takes each field from the variant with a cast, so numbers that
were written as texts are numbers; it names the first required field that is missing or wrong. Rows of an older version are brought to the
newest by that version's upgrade, a function of Columns. Everything is built-in functions; no row fails a read.

Defined results: texts that are no JSON object are INVALID_FORMAT; versions without a reader are SCHEMA_VERSION; a missing optional field
has its default; fields that no reader knows are left out; open objects (metadata, structure, details, raw_result) stay variants. Nested records must
have their own version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ERROR, LOCATOR
from .files import error, no_error

# Fields of the data model's records, and values their enumerations have.
FORMATS = ("txt", "epub2", "epub3", "image", "cbz")
STATUSES = ("source", "succeeded", "manual", "failed", "cancelled")
BATCHES = ("succeeded", "partially_succeeded", "failed", "cancelled", "noop")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    default: object = None
    among: tuple[str, ...] = ()
    nested: str | None = None  # the version that nested records must have


def _fields(required: str = "", texts: str = "", optional: str = "", **more: Field) -> tuple[Field, ...]:
    """Required fields, texts that are empty by default, optional ones (``name:kind``, a text without kind)."""
    split = lambda s: [(n, k or "string") for n, _, k in (x.partition(":") for x in s.split())]
    out = [Field(n, k, True) for n, k in split(required)] + [Field(n, "string", default="") for n in texts.split()] + [Field(n, k) for n, k in split(optional)]
    return tuple(out + list(more.values()))


def _struct(version: str) -> str:
    return "struct<" + ",".join(["schema_version:string"] * (version not in PARTS) + [f"`{f.name}`:{f.kind}" for f in (PARTS | CURRENT)[version]]) + ">"


_FORMAT = Field("source_format", "string", True, among=FORMATS)
#: Records that lie inside others and have no version of their own.
PARTS: dict[str, tuple[Field, ...]] = {
    "page": _fields("page_id order:int name media_type source_sha256 source_size:bigint", optional="archive_member"),
    "page_result": _fields("page_id order:int name", optional="media_type image_base64 image_size:bigint raw_result:variant logs:array<string>", status=Field("status", "string", True, among=STATUSES), attempts=Field("attempts", "int", default=0), error=Field("error", ERROR)),
}
CURRENT: dict[str, tuple[Field, ...]] = {
    "segment.v1": _fields("segment_id order:int", "source_document source_text source_hash translation_input_hash joiner", format=_FORMAT, role=Field("content_role", "string", default="body"), locator=Field("locator", LOCATOR, True)),
    "translation-record.v1": _fields("segment_id order:int", "source_hash translation_input_hash", "translated_text provider_id model usage:map<string,bigint>", status=Field("status", "string", True, among=STATUSES), attempts=Field("attempts", "int", default=0), error=Field("error", ERROR)),
    "build-result.v1": _fields("output_sha256 output_size:bigint translated_count:bigint preserved_count:bigint", optional="details:variant", format=_FORMAT),
}
CURRENT["document-manifest.v1"] = _fields("source_sha256 source_size:bigint", optional="filename encoding encoding_confidence:double newline metadata:variant structure:variant", format=_FORMAT, segmentation=Field("segmentation_version", "string", default="txt-segmentation.v1"), segments=Field("segments", f"array<{_struct('segment.v1')}>", default="[]", nested="segment.v1"))
CURRENT["translation-batch.v1"] = _fields(optional="source_sha256 selected_segment_ids:array<string>", status=Field("status", "string", True, among=BATCHES), records=Field("records", f"array<{_struct('translation-record.v1')}>", default="[]", nested="translation-record.v1"))
CURRENT["manga-manifest.v1"] = _fields("source_sha256 source_size:bigint", optional="filename", format=_FORMAT, pages=Field("pages", f"array<{_struct('page')}>", default="[]"))
CURRENT["manga-translation.v1"] = _fields("adapter_id", status=Field("status", "string", True, among=BATCHES), manifest=Field("manifest", _struct("manga-manifest.v1"), True, nested="manga-manifest.v1"), pages=Field("pages", f"array<{_struct('page_result')}>", default="[]"))
CURRENT["document-translation.v1"] = (
    Field("manifest", _struct("document-manifest.v1"), True, nested="document-manifest.v1"),
    Field("translations", _struct("translation-batch.v1"), True, nested="translation-batch.v1"),
    Field("build", _struct("build-result.v1"), True, nested="build-result.v1"),
)


@dataclass(frozen=True)
class Reader:
    """How one version is read: its fields, and how a row of it becomes one of the next version."""

    fields: tuple[Field, ...]
    upgrade: Callable[[dict[str, Column]], dict[str, Column]] | None = field(default=None)


def _taken(f: Field, body: Column) -> Column:
    value = F.try_variant_get(body, f"$.{f.name}", f.kind)
    if f.default is None:
        return value
    return F.coalesce(value, F.from_json(F.lit("[]"), f.kind) if f.default == "[]" else F.lit(f.default).cast(f.kind))


def _of(version: str) -> Callable[[Column], Column]:
    return lambda x: x["schema_version"].eqNullSafe(F.lit(version))


def _wrong(fields: tuple[Field, ...], body: Column) -> Column:
    """The first field that can't be read, or null."""
    out = []
    for f in fields:
        value, there = F.try_variant_get(body, f"$.{f.name}", f.kind), ~F.is_variant_null(F.coalesce(F.try_variant_get(body, f"$.{f.name}", "variant"), F.parse_json(F.lit("null"))))
        bad = there & value.isNull()
        if f.required:
            bad = bad | ~there
        if f.among:
            bad = bad | (value.isNotNull() & ~value.isin(*f.among))
        if f.nested:
            own = F.forall(value if f.kind.startswith("array") else F.array(value), _of(f.nested))
            bad = bad | (value.isNotNull() & ~own)
        out.append(F.when(bad, F.lit(f.name)))
    return F.coalesce(*out)


def loaded(rows: DataFrame, version: str, older: Mapping[str, Reader] | None = None, value: str = "value") -> DataFrame:
    """The records of JSON texts ``value`` as columns of ``version``, with a ``problem`` where one can't be read; other columns stay.

    ``older`` has the readers of versions before, oldest first; each upgrades to the next, the last one to ``version``."""
    readers = {**(older or {}), version: Reader(CURRENT[version])}
    names = [f.name for f in CURRENT[version]]
    kept = [c for c in rows.columns if c != value and c not in (*names, "schema_version", "problem")]
    parsed = rows.withColumn("_body", F.try_parse_json(value)).withColumn("_version", F.try_variant_get("_body", "$.schema_version", "string"))
    shape = F.schema_of_variant("_body").startswith("OBJECT")
    columns: dict[str, Column] = {n: F.lit(None) for n in names}
    wrong = F.lit(None).cast("string")
    order = list(readers)
    for i, own in enumerate(order):
        made = {f.name: _taken(f, F.col("_body")) for f in readers[own].fields}
        for later in order[i:-1]:
            made = readers[later].upgrade(made)
        mine = F.col("_version") == own
        columns = {n: F.when(mine, made[n]).otherwise(columns[n]) for n in names}
        wrong = F.when(mine, _wrong(readers[own].fields, F.col("_body"))).otherwise(wrong)
    problem = (
        F.when(F.col("_body").isNull() | ~shape, error("INVALID_FORMAT", "not a JSON object"))
        .when(~F.coalesce(F.col("_version").isin(*order), F.lit(False)), error("SCHEMA_VERSION", f"expected {version}"))
        .when(wrong.isNotNull(), error("INVALID_FORMAT", F.concat(F.lit("field "), wrong)))
        .otherwise(no_error())
    )
    return parsed.select(*kept, F.lit(version).alias("schema_version"), *[columns[n].alias(n) for n in names], problem.alias("problem"))


def stored(version: str, rows: DataFrame) -> Column:
    """Records with a version's columns as JSON texts, with their version first and nulls kept."""
    return F.to_json(F.struct(F.lit(version).alias("schema_version"), *[F.col(f"`{f.name}`") for f in CURRENT[version] if f.name in rows.columns]), {"ignoreNullFields": "false"})
