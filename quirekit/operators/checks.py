"""Quality findings, reuse of earlier results, rebuild and comparison of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schemas import DONE, SUCCEEDED


def findings(records: DataFrame) -> DataFrame:
    """One row a finding of (segment_id, source_text, status, translated_text): missing, unchanged, or of unusual length."""
    finding = lambda category, severity: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))
    missing = (F.col("status") != SUCCEEDED) | F.col("status").isNull() | (F.coalesce(F.col("translated_text"), F.lit("")) == "")
    ratio = fx.length_ratio(F.col("source_text"), F.col("translated_text"))
    some = F.array(
        F.when(missing, finding("missing_translation", "error")),
        F.when(~missing & (fx.strip(F.col("translated_text")) == fx.strip(F.col("source_text"))), finding("unchanged_text", "warning")),
        F.when(~missing & ((ratio < 0.25) | (ratio > 4.0)), finding("length_ratio", "warning")),
    )
    rows = records.withColumn("ratio", F.when(~missing, ratio)).withColumn("finding", F.explode(F.filter(some, lambda f: f.isNotNull())))
    return rows.withColumn("category", F.col("finding.category")).withColumn("severity", F.col("finding.severity")).drop("finding")


def with_findings(segments: DataFrame, found: DataFrame) -> DataFrame:
    """``segments`` with the categories of their findings, joined in order."""
    per = found.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("findings"), F.count("*").alias("n_findings"))
    return segments.join(per, "segment_id", "left").withColumn("findings", F.coalesce("findings", F.lit(""))).withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def reusable(records: DataFrame, project: str, key: str, job: str, newest: str) -> DataFrame:
    """For each project, input key and job the newest done result of another job.

    Only the two newest jobs of a key can matter, so the history shrinks to two rows a key before the join."""
    done = records.filter((F.col("status") == SUCCEEDED) & F.col("translated_text").isNotNull())
    own = done.groupBy(project, key, job).agg(F.max(F.struct(newest, job, "translated_text")).alias("r"))
    rank = F.row_number().over(Window.partitionBy(project, key).orderBy(F.col("r").desc()))
    two = own.withColumn("rank", rank).filter("rank <= 2")
    best = two.groupBy(project, key).agg(F.max(F.when(F.col("rank") == 1, F.col("r"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("r"))).alias("second"))
    mine = records.select(project, key, job).distinct()
    pick = F.when(F.col(f"first.{job}") != F.col(job), F.col("first")).otherwise(F.col("second"))
    return mine.join(best, [project, key], "left").withColumn("pick", pick).select(project, key, job, F.col(f"pick.{job}").alias("from_job"), F.col("pick.translated_text").alias("reused_text"))


def carried_over(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """``now`` with ``carried``, the text an earlier row of equal keys has; the last by text among several."""
    had = before.groupBy(*keys).agg(F.max("translated_text").alias("carried"))
    return now.join(had, keys, "left")


def taken(record_status: Column, translated: Column) -> Column:
    """Whether a rebuild takes a segment's result."""
    return F.coalesce(record_status.isin(*DONE) & translated.isNotNull(), F.lit(False))


def value_of(record_status: Column, translated: Column, source: Column) -> Column:
    """Text that a rebuild puts in a segment's place."""
    return F.when(taken(record_status, translated), translated).otherwise(source)


def rebuilt(units: DataFrame, key: str, value: str = "value", *more: Column) -> DataFrame:
    """(key, text, ...): each document's units joined in order, with what stands between them; ``more`` are further sums of a document."""
    parts = F.sort_array(F.collect_list(F.struct("order", F.col(value).alias("v"), F.col("joiner").alias("j"))))
    return units.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: F.concat(p["v"], p["j"])), "").alias("text"), *more)


def slots(parts: DataFrame, keys: list[str], value: str = "source_text") -> DataFrame:
    """Slots regrouped from their parts, with whether all parts are there."""
    ordered = F.sort_array(F.collect_list(F.struct("part_index", F.col(value).alias("v"), "joiner")))
    out = parts.groupBy(*keys).agg(ordered.alias("p"), F.max("part_count").alias("part_count"))
    whole = (F.size("p") == F.col("part_count")) & F.forall(F.transform(F.col("p"), lambda x, i: x["part_index"] == i), lambda ok: ok)
    return out.select(*keys, "part_count", whole.alias("complete"), F.array_join(F.transform("p", lambda x: F.concat(x["v"], x["joiner"])), "").alias("text"))


def manifest_difference(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Positions at which two manifests differ: missing on a side, or other values."""
    tagged = lambda df, side: df.select(*keys, F.struct(*values).alias(side))
    both = tagged(left, "l").join(tagged(right, "r"), keys, "full_outer")
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(*keys, F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("changed").alias("difference"))
