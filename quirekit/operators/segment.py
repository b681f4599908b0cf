"""Deterministic segmentation of texts into translation units.

Texts split into paragraphs at blank lines; a paragraph longer than the limit is cut at its last sentence end inside the limit, else at
its last whitespace, else hard. Cutting is sequential inside a paragraph, so it runs in Arrow batches; everything else is built in.
Markup slots are cut by a rule of their own that keeps every character.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text as fx
from ..schemas import MAX_SEGMENT, SLOT_MAX
from ..session import batched

_BLANK = re.compile(r"\n[ \t]*\n+")
#: The longest start of a window that ends in a sentence end, or in anything solid, before whitespace.
_SENTENCE = re.compile(r".*[。！？.!?；;](?=\s)", re.DOTALL)
_SOLID = re.compile(r".*\S(?=\s)", re.DOTALL)
_SLOT_ENDS = frozenset(".!?。！？；;")


def paragraph_cuts(body: str, limit: int) -> list[tuple[int, int]]:
    """Spans of a paragraph's units, relative to its start."""
    at, end, out = len(body) - len(body.lstrip()), len(body.rstrip()), []
    while end - at > limit:
        window = body[at : at + limit]
        found = _SENTENCE.match(window) or _SOLID.match(window)
        size = found.end() if found else limit
        out.append((at, at + size))
        at += size
        while at < end and body[at].isspace():
            at += 1
    if at < end:
        out.append((at, end))
    return out


def text_cuts(body: str, limit: int = MAX_SEGMENT) -> list[tuple[int, int]]:
    """Spans of all units of a text."""
    out, low = [], 0
    for high, after in [*((m.start(), m.end()) for m in _BLANK.finditer(body)), (len(body), len(body))]:
        out += [(low + a, low + b) for a, b in paragraph_cuts(body[low:high], limit)]
        low = after
    return out


def slot_cuts(body: str, limit: int = SLOT_MAX) -> list[tuple[int, int, int]]:
    """(start, end, end with the whitespace that follows) of a slot's parts; together they are the slot."""
    out, at = [], 0
    while len(body) - at > limit:
        top, least = at + limit, at + limit // 2
        end = next((i + 1 for i in range(top - 1, least - 1, -1) if body[i] in _SLOT_ENDS), 0)
        if not end:
            runs = [m.start() for m in re.finditer(r"\s+", body[at:top]) if m.start() >= limit // 2]
            end = at + runs[-1] if runs else top
        after = end
        while after < len(body) and body[after].isspace():
            after += 1
        out.append((at, end, after))
        at = after
    out.append((at, len(body), len(body)))
    return out


#: Texts that are cut before their spans are handed on; what Python holds of them besides the batch doesn't grow with it.
_AT_ONCE = 64


def _spans_udf(cuts, width: int, kept: list[str]):
    names = ["start", "end", "after"][:width]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                offsets, flat = [0], []
                for body in part.column("text"):
                    found = cuts(body.as_py()) if body.is_valid else []
                    flat += found
                    offsets.append(len(flat))
                fields = [pa.array([s[i] for s in flat], pa.int32()) for i in range(width)]
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names), mask=pa.compute.is_null(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), spans], [*kept, "spans"])

    return run


def _with_spans(docs: DataFrame, cuts, width: int, kept: list[str]) -> DataFrame:
    batched(docs.sparkSession)
    types = dict(docs.dtypes)
    fields = ", ".join(f"`{n}` {types[n]}" for n in kept)
    spans = ",".join(f"{n}:int" for n in ("start", "end", "after")[:width])
    return docs.mapInArrow(_spans_udf(cuts, width, kept), f"{fields}, spans array<struct<{spans}>>")


def with_spans(docs: DataFrame, limit: int = MAX_SEGMENT, kept: list[str] | None = None) -> DataFrame:
    """``docs`` (of these columns only, if given) with ``spans``, the units of ``text`` (null for a null text)."""
    return _with_spans(docs, lambda b: text_cuts(b, limit), 2, kept or docs.columns)


def with_slot_spans(docs: DataFrame, limit: int = SLOT_MAX) -> DataFrame:
    """``docs`` with ``spans``, the parts of the slot ``text`` and where their joiners end."""
    return _with_spans(docs, lambda b: slot_cuts(b, limit), 3, docs.columns)


def unit_places(docs: DataFrame, key: str, limit: int = MAX_SEGMENT) -> DataFrame:
    """(key, order, start, end) of the units of the texts (``key``, text); no text comes back from Python."""
    spanned = with_spans(docs.select(key, "text").filter(F.col("text").isNotNull()), limit, [key])
    return spanned.select(key, F.posexplode("spans").alias("order", "span")).select(key, "order", "span.start", "span.end")


def segment_texts(docs: DataFrame, key: str, options: dict | None = None, limit: int = MAX_SEGMENT) -> DataFrame:
    """One row a unit of the texts (``key``, text): order, span, text, joiner to the next unit, role and identities.

    The joiner comes from the neighbouring span in the same array, so no window and no shuffle is needed."""
    from ..operators.translate import OPTIONS

    body = F.col("text")
    spanned = with_spans(docs.select(key, "text").filter(body.isNotNull()), limit)
    source = ids.sha_text(body)
    rows = spanned.select(key, "text", source.alias("source_sha256"), "spans", F.posexplode("spans").alias("order", "span"))
    until = F.coalesce(F.get("spans", F.col("order") + 1)["start"], F.length("text"))
    cut = lambda a, b: F.substring("text", a + 1, b - a)
    rows = rows.select(
        key, "source_sha256", "order", F.col("span.start").alias("start"), F.col("span.end").alias("end"), cut(F.col("span.start"), F.col("span.end")).alias("source_text"), cut(F.col("span.end"), until).alias("joiner")
    )
    rows = rows.withColumn("content_role", fx.content_role(F.col("source_text"))).withColumn("source_hash", ids.sha_text(F.col("source_text")))
    rows = rows.withColumn("segment_id", ids.txt_segment_id(F.col("source_sha256"), F.col("start"), F.col("end"), F.col("source_hash")))
    return rows.withColumn("translation_input_hash", ids.input_hash(F.col("segment_id"), F.col("source_hash"), options or OPTIONS))


def slot_parts(docs: DataFrame, key: str) -> DataFrame:
    """One row a part of each slot (``key``, text): part_index, part_count, text and joiner."""
    spanned = with_slot_spans(docs.select(key, "text").filter(F.length(fx.strip(F.col("text"))) > 0).withColumn("text", fx.strip(F.col("text"))))
    rows = spanned.select(key, "text", F.size("spans").alias("part_count"), F.posexplode("spans").alias("part_index", "s"))
    cut = lambda a, b: F.substring("text", a + 1, b - a)
    return rows.select(key, "part_index", "part_count", cut(F.col("s.start"), F.col("s.end")).alias("source_text"), cut(F.col("s.end"), F.col("s.after")).alias("joiner"))


def joiners(units: DataFrame, key: str, length: Column) -> DataFrame:
    """Window form of the joiner's span, for units that come as rows: from each unit's end to the next one's start."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("order"))
    return units.withColumn("joiner_start", F.col("end")).withColumn("joiner_end", F.coalesce(following, length))
