"""Running sums and first occurrences over groups of any size: no group is one task's.

Rows are dealt to range partitions by group and order, and written, so that each row's partition is fixed. A partition's total for each of its groups
is one row; a group has at most as many as there are partitions, and their running sums are the offsets at which its partitions begin. What is
left is a running sum within a partition's part of a group. Only the small totals meet by group.

Defined results: null groups are one group; null values add nothing; rows of equal order come in any order, but each once; an empty table
gives an empty result. A group and order value that many rows share stay together, so order should be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def dealt(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part``, the number of their range partition, as a written table."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "running", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group up to themselves, in ``order``."""
    placed = dealt(rows.withColumn("_value", F.coalesce(value, F.lit(0))), by, order, parts)
    totals = placed.groupBy("_part", *by).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_inside", F.sum("_value").over(inside)).join(offsets, same)
    return out.withColumn(name, F.col("_offset") + F.col("_inside")).select(*rows.columns, name)


def starts(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "start", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group before themselves."""
    return running_sums(rows, by, order, value, "_upto", parts).withColumn(name, F.col("_upto") - F.coalesce(value, F.lit(0))).drop("_upto")


def first_occurrences(rows: DataFrame, by: list[str], key: str, order: str, parts: int | None = None) -> DataFrame:
    """(by, key, first, place): each key of a group once, where it came first, numbered from 0 in that order. Repeats combine before they shuffle."""
    firsts = rows.groupBy(*by, key).agg(F.min(order).alias("first"))
    return starts(firsts, by, ["first", key], F.lit(1), "place", parts)


def over_limit(rows: DataFrame, by: list[str], order: list[str], size: Column, limit: int, parts: int | None = None) -> DataFrame:
    """The first row of each group at which the running size passes a limit, with ``running``: where a reader of that archive stops."""
    passed = running_sums(rows, by, order, size, "running", parts).filter(F.col("running") > limit)
    first = F.min_by(F.struct(*passed.columns), F.struct(*order))
    return passed.groupBy(*by).agg(first.alias("_first")).select("_first.*")
