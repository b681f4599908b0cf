"""Joins that find a segment's row by more than one kind of address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schemas import SUCCEEDED


def by_id_or_place(segments: DataFrame, rows: DataFrame, value: str, key: str = "segment_id", place: tuple[str, ...] = ("order", "source_text")) -> DataFrame:
    """``segments`` with ``value`` of the row of equal id, else of the row without id at the same place and of equal text."""
    named = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("_by_id"))
    placed = rows.filter(F.col(key).isNull()).groupBy(*place).agg(F.max(value).alias("_by_place"))
    out = segments.join(named, key, "left").join(placed, list(place), "left")
    return out.withColumn(value, F.coalesce("_by_id", "_by_place")).drop("_by_id", "_by_place")


def unmatched(joined: DataFrame, value: str) -> DataFrame:
    """Segments that no row was found for: a source that has changed."""
    return joined.filter(F.col(value).isNull())


def normalised(status: Column, *candidates: Column) -> Column:
    """Text of a result: of the first field that is there, stripped; null where blank or where a given status isn't a success."""
    body = F.coalesce(*candidates)
    fine = status.isNull() | F.lower(status).isin(SUCCEEDED, "success", "ok")
    return F.when(fine & (fx.strip(body) != ""), fx.strip(body))


# Kinds of keys a mapping of translations may have.
NUMBER, TEXT, TUPLE = "number", "text", "tuple"


def addressed(units: DataFrame, entries: DataFrame) -> DataFrame:
    """``units`` (doc, sequence, locator_key[, locator_tuple]) with ``value`` of a mapping's entries (doc, address, value[, kind]).

    A unit is looked for by its sequence as a number, as text, by its locator's key and by the tuple of its locator's values; the first of these
    addresses that an entry has decides, even where its value is null. Entries without a kind are texts; of equal ones the largest value counts."""
    if "kind" not in entries.columns:
        entries = entries.withColumn("kind", F.lit(TEXT))
    # Units and entries are dealt out once, by document; the ways are spread, matched and ranked where the document's rows are, in sorted windows.
    told = entries.filter("doc is not null and kind is not null and address is not null").select("doc", F.lit(None).cast(units.select(F.struct("*")).schema[0].dataType).alias("unit"), "kind", "address", "value")
    asked = units.select("doc", F.struct("*").alias("unit"))
    dealt = asked.unionByName(told, allowMissingColumns=True).repartition("doc")
    of = lambda name: F.col(f"unit.{name}")
    number, is_unit = of("sequence").cast("string"), F.col("unit").isNotNull()
    ways = [(NUMBER, number), (TEXT, number), (TEXT, of("locator_key"))] + ([(TUPLE, of("locator_tuple"))] if "locator_tuple" in units.columns else [])
    way = lambda rank, kind, address: F.struct(F.lit(rank).alias("rank"), kind.alias("kind"), address.alias("address"))
    tried = F.when(is_unit, F.array(*[way(i, F.lit(kind), address) for i, (kind, address) in enumerate(ways)])).otherwise(F.array(way(-1, F.col("kind"), F.col("address"))))
    spread = dealt.select("doc", of("sequence").alias("sequence"), "unit", "value", F.explode(tried).alias("way"))
    spread = spread.select("doc", "sequence", F.when(F.col("way.rank") == 0, F.col("unit")).alias("unit"), "value", "way.*")  # a unit's columns travel once
    held = F.max(F.when(F.col("rank") < 0, F.struct("value"))).over(Window.partitionBy("doc", "kind", "address"))
    found = spread.withColumn("hit", held).filter("rank >= 0").select("doc", "sequence", "unit", "rank", "hit")
    best = F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("rank"))).over(Window.partitionBy("doc", "sequence"))
    ranked = found.withColumn("best", best).filter("rank = 0")
    others = [of(c).alias(c) for c in units.columns if c not in ("doc", "sequence", "value")]
    return ranked.select("doc", "sequence", *others, F.when(F.col("sequence").isNotNull(), F.col("best.value")).alias("value"))


def addressed_list(units: DataFrame, records: DataFrame) -> DataFrame:
    """``units`` (doc, sequence, locator_key) with ``value`` of a list's records (doc, position, sequence as text, locator_key, value).

    A record goes to the sequence it names, else to that of its locator, else, where it names neither or an unknown locator, to the one of its own position.
    Sequences that are no whole number, or that no unit has, go nowhere. Records without a value are passed over; of several the last one counts."""
    size = units.groupBy("doc").agg(F.count("*").alias("_size"))
    placed = units.groupBy("doc", "locator_key").agg(F.max("sequence").alias("_placed"))
    found = records.filter("value is not null").join(size, "doc").join(placed, ["doc", "locator_key"], "left")
    named = F.when(F.col("sequence").rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.regexp_replace("sequence", r"[\s_+]", "").try_cast("long"))
    goal = F.when(F.col("sequence").isNotNull(), named).otherwise(F.coalesce("_placed", "position")).cast("long")
    found = found.withColumn("_goal", goal).filter(F.col("_goal").between(0, F.col("_size") - 1))
    last = found.groupBy("doc", F.col("_goal").alias("sequence")).agg(F.max_by("value", "position").alias("value"))
    return units.join(last, ["doc", "sequence"], "left")


def carried_segments(fresh: DataFrame, history: DataFrame, own: DataFrame) -> DataFrame:
    """Rows for a job's new segments (input_hash, order, source_text): text from another job of equal input hash (history: input_hash,
    reused_text), else from the job's own earlier rows at the same place and of equal text, else pending."""
    past = history.groupBy("input_hash").agg(F.max("reused_text").alias("_past"))
    before = own.filter(F.col("status") == SUCCEEDED).groupBy("order", "source_text").agg(F.max("translated_text").alias("_own"))
    out = fresh.join(past, "input_hash", "left").join(before, ["order", "source_text"], "left")
    text = F.coalesce("_past", "_own")
    origin = F.when(F.col("_past").isNotNull(), "other_job").when(F.col("_own").isNotNull(), "same_job")
    return out.withColumn("translated_text", text).withColumn("origin", origin).withColumn("status", F.when(text.isNotNull(), SUCCEEDED).otherwise("pending")).drop("_past", "_own")
