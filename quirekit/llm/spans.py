"""Spans of regular-expression matches with code-point positions, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,end:int,m:string>>"
#: Matches of one text are offset in blocks, so that many matches don't cost their square.
_BLOCK = 256
#: Code points in a chunk of a text.
_CHUNK = 4096


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _offsets(s: Column) -> Column:
    """Spans of the matches ``s.ms``, which stand between the pieces ``s.gaps``."""
    steps = F.zip_with(s["ms"], F.slice(s["gaps"], F.lit(1), F.size(s["ms"])), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))

    def placed(t: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(t) - 1) / F.lit(_BLOCK)).cast("int"))
        total = F.transform(blocks, lambda b: F.aggregate(F.slice(t, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        before = F.aggregate(total, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def place(base: Column) -> Column:
            return F.transform(
                t,
                lambda x, i: let(
                    base[F.floor(i / F.lit(_BLOCK)).cast("int")]
                    + F.aggregate(F.slice(t, i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, y: a + y["g"] + y["n"])
                    + x["g"],
                    lambda at: F.struct(at.alias("start"), (at + x["n"]).alias("end"), x["m"].alias("m")),
                ),
            )

        return let(before, place)

    return let(steps, placed)


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (never empty ones) as start, end, text.

    ``gate`` is a cheap condition that every text with a match meets."""
    has = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(has, let(both, _offsets)).otherwise(no_spans())


def chunked(text: Column) -> Column:
    """The text in chunks of _CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def piece(chunks: Column, low: Column, high: Column) -> Column:
    """The chunked text from code point ``low`` up to ``high``: what lies far from the start costs no more than what lies near it."""
    first, last = F.floor(low / F.lit(_CHUNK)).cast("int"), F.floor(high / F.lit(_CHUNK)).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    head = F.substring(at(first), low - first * _CHUNK + 1, F.least(high - low, F.lit(_CHUNK)))
    rest = F.concat(F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(at(last), F.lit(1), high - last * _CHUNK))
    return F.when(low >= high, "").when(first == last, head).otherwise(F.concat(head, rest))


def reaches(found: Column) -> Column:
    """For each of the spans, sorted by start, the largest end of those before it; 0 for the first."""

    def of(t: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(t) - 1) / F.lit(_BLOCK)).cast("int"))
        most = F.transform(blocks, lambda b: F.aggregate(F.slice(t, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: F.greatest(a, x["end"])))
        before = F.aggregate(most, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x))))
        inside = lambda i: F.aggregate(F.slice(t, i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, y: F.greatest(a, y["end"]))
        return let(before, lambda base: F.transform(t, lambda x, i: F.greatest(base[F.floor(i / F.lit(_BLOCK)).cast("int")], inside(i))))

    return F.when(F.size(found) > 0, let(found, of)).otherwise(F.array().cast("array<int>"))


def heads(found: Column) -> Column:
    """Of spans sorted by start those that begin no earlier than all before them end, with ``low``, where those before it end, and ``before``,
    where the head before it begins; one without an end stands for the text's end. Between low and start the text is free."""

    def of(s: Column) -> Column:
        reach = F.zip_with(s, reaches(s), lambda x, r: F.struct(r.alias("low"), x["start"].alias("start"), x["label"].alias("label")))
        first = F.filter(reach, lambda x: x["start"] >= x["low"])
        last = F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        every = F.concat(first, F.array(F.struct(last.alias("low"), F.lit(None).cast("int").alias("start"), F.lit("").alias("label"))))
        starts = lambda e: F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["start"]))
        joined = lambda e: F.zip_with(e, F.slice(starts(e), F.lit(1), F.size(e)), lambda x, b: F.struct(x["low"].alias("low"), x["start"].alias("start"), x["label"].alias("label"), b.alias("before")))
        return let(every, joined)

    return let(found, of)


def replaced(text: Column, found: Column) -> Column:
    """The text with its sorted spans (start, end, label), merged where they overlap, replaced by the first one's label."""
    one = lambda chunks, end: lambda x: F.concat(piece(chunks, x["low"], F.coalesce(x["start"], end)), x["label"])
    whole = lambda h: let(F.struct(chunked(text).alias("chunks"), F.length(text).alias("end")), lambda t: F.array_join(F.transform(h, one(t["chunks"], t["end"])), ""))
    return F.when(F.size(found) > 0, let(heads(found), whole)).otherwise(text)


def blanked(text: Column, found: Column) -> Column:
    """The text with spaces in place of its sorted spans, so that all else keeps its place."""
    one = lambda chunks, end: lambda x: F.concat(F.repeat(F.lit(" "), x["low"] - x["before"]), piece(chunks, x["low"], F.coalesce(x["start"], end)))
    whole = lambda h: let(F.struct(chunked(text).alias("chunks"), F.length(text).alias("end")), lambda t: F.array_join(F.transform(h, one(t["chunks"], t["end"])), ""))
    return F.when(F.size(found) > 0, let(heads(found), whole)).otherwise(text)


def listed(found: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(found, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def tagged(found: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank of the kind, end, label), for sorting by start, then kind."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("label")))
