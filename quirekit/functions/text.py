"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's str.isspace has it; Java's \s and trim() know less.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Opening marks of dialogue, sentence ends, media types by suffix, adapter language codes, the grammar of language tags,
# names and forms of secrets, references in style sheets, and what stands in a secret's place.
REDACTED = "[REDACTED]"
OPENERS = "“‘\"「『—"
ENDS = "。！？.!?"
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
ADAPTER_LANGUAGES = {
    "en": "ENG",
    "en-us": "ENG",
    "english": "ENG",
    "zh": "CHS",
    "zh-cn": "CHS",
    "chinese": "CHS",
    "zh-tw": "CHT",
    "ja": "JPN",
    "japanese": "JPN",
    "ko": "KOR",
    "korean": "KOR",
    "fr": "FRA",
    "de": "DEU",
    "es": "ESP",
    "it": "ITA",
    "ru": "RUS",
}
BCP47 = (
    r"^(?i:x(?:-[a-z0-9]{1,8})+|[a-z]{2,3}(?:-[a-z]{3}){0,3}(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?"
    r"(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[a-wyz0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?)$"
)
SENSITIVE_KEY = r"api[-_]?key|authorization|access[-_]?token|secret|password"
SENSITIVE = rf"(?i)({SENSITIVE_KEY})(\s*[:=]\s*)([^\s,;]+)"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
CSS_REFERENCE = r"(?i)(?:url\(\s*|@import\s+)['\"]?([^'\")\s;]+)"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def outer_space(c: Column) -> tuple[Column, Column, Column]:
    """Leading whitespace, core and trailing whitespace; they join to ``c``."""
    lead = F.regexp_extract(c, f"^({WS}*)", 1)
    core = strip(c)
    return lead, core, F.substring(c, F.length(lead) + F.length(core) + 1, F.length(c))


def plain_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^﻿+", ""), r"\r\n?", "\n")


def newline_style(c: Column) -> Column:
    crlf = F.regexp_count(c, F.lit(r"\r\n"))
    rest = F.replace(c, F.lit("\r\n"), F.lit(""))
    cr, lf = F.regexp_count(rest, F.lit(r"\r")), F.regexp_count(rest, F.lit(r"\n"))
    used = (crlf > 0).cast("int") + (cr > 0).cast("int") + (lf > 0).cast("int")
    return F.when(used > 1, "mixed").when(crlf > 0, "crlf").when(cr > 0, "cr").when(lf > 0, "lf").otherwise("none")


def content_role(c: Column) -> Column:
    body = strip(c)
    short = ~F.contains(body, F.lit("\n")) & (F.length(body) <= 100) & ~body.rlike(f"[{ENDS}]$")
    return F.when(body.rlike(f"^[{OPENERS}]"), "dialogue").when(short, "heading").otherwise("paragraph")


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Hides bearer tokens first, then the values of named keys, then the given secrets."""
    out = F.regexp_replace(c, BEARER, f"Bearer {REDACTED}")
    out = F.regexp_replace(out, SENSITIVE, f"$1$2{REDACTED}")
    for secret in filter(None, secrets):
        out = F.replace(out, F.lit(secret), F.lit(REDACTED))
    return out


def language_tag_ok(c: Column) -> Column:
    """Structure of a language tag: at most 255 characters, the grammar, no singleton twice before a private part."""
    tag = F.lower(c)
    public = F.regexp_replace(F.concat(tag, F.lit("-")), "-x-.*$", "-")
    singles = F.regexp_extract_all(public, F.lit("-([a-wyz0-9])(?=-)"), F.lit(1))
    return (F.length(c) <= 255) & c.rlike(BCP47) & (F.size(F.array_distinct(singles)) == F.size(singles))


def safe_filename(c: Column) -> Column:
    kept = F.regexp_replace(F.element_at(F.split(c, "/"), -1), "[^A-Za-z0-9._-]+", "_")
    out = F.substring(F.regexp_replace(kept, "^[._]+|[._]+$", ""), 1, 180)
    return F.when(out == "", "artifact.bin").otherwise(out)


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-")


def artifact_stem(c: Column) -> Column:
    """Name without folder and suffix, safe for a download's name."""
    bare = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    out = F.regexp_replace(slug(bare), "^[.-]+|[.-]+$", "")
    return F.when(out == "", "document").otherwise(out)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def prompt(template: str, source: Column, target: Column, style: Column, text: Column) -> Column:
    """The template with its four placeholders filled; others are refused here, on the driver."""
    names = {"source_language": source, "target_language": target, "style": style, "text": text}
    pieces = re.split(r"\{(\w+)\}", template)
    unknown = set(pieces[1::2]) - set(names)
    if unknown or re.search(r"[{}]", "".join(pieces[::2])):
        raise ValueError(f"unknown placeholders: {sorted(unknown)}")
    return F.concat(*[names[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


FAIL_MARK = "[[MOCK_FAIL]]"


def mock_translation(text: Column, target: Column) -> Column:
    """The offline provider's answer; null where the text asks it to fail."""
    return F.when(~F.contains(text, F.lit(FAIL_MARK)), F.concat(F.lit("["), target, F.lit("] "), text))


def length_ratio(text: Column, translated: Column) -> Column:
    return F.length(translated) / F.greatest(F.length(text), F.lit(1))


def backoff_seconds(base: Column, attempt: Column) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(10.0))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def iso_utc(c: Column) -> Column:
    """A time as it is told, with six decimals. Times without a zone never pass through the session's, which may lack them (clocks put forward)."""
    told = F.regexp_replace(c.cast("timestamp_ntz").cast("string"), r"^\+", "")
    return F.concat(F.translate(F.substring_index(told, ".", 1), " ", "T"), F.lit("."), F.rpad(F.regexp_extract(told, r"\.(\d+)$", 1), 6, "0"), F.lit("Z"))


def compression_ratio(size: Column, compressed: Column) -> Column:
    return F.when(size == 0, 0.0).when(compressed <= 0, float("inf")).otherwise(size / compressed)


def unsafe_member(name: Column, strict: bool = True, depth: int = 20) -> Column:
    """Why a member path is refused, or null. ``strict`` also refuses the control characters from 0x7F."""
    control = r"[\x00-\x1f\x7f-\x9f]" if strict else r"[\x00-\x1f]"
    parts = F.split(F.regexp_replace(name, "/$", ""), "/")
    return (
        F.when((name == "") | F.contains(name, F.lit("\\")), "path")
        .when(name.rlike(control), "control")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "path")
        .when(F.contains(parts[0], F.lit(":")), "path")
        .when(F.size(parts) > depth, "depth")
    )


def css_references(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), F.lit(CSS_REFERENCE), F.lit(1))


def html_references(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']([^"']*)["']"""), F.lit(1))


def declares_entities(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("\x00"), F.lit(""))).rlike(r"<!ENTITY|<!DOCTYPE[^>]*\[")


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for key, value in MEDIA.items():
        out = F.when(suffix == key, value).otherwise(out)
    return out


def adapter_language(c: Column) -> Column:
    out = F.upper(c)
    for key, value in ADAPTER_LANGUAGES.items():
        out = F.when(F.lower(c) == key, value).otherwise(out)
    return out


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value and the rest by lower case: digits become their count, then their digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 4, "0"), bare(p))).otherwise(p)), "\x01")
