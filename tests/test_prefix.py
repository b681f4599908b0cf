"""Running sums over range partitions against plain ones."""

import random

from pyspark.sql import functions as F

from quirekit.operators import prefix


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, -3, 0, 5, 9])) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, o int, v long").repartition(5)
    got = {(x["g"], x["o"]): (x["v"], x["running"]) for x in prefix.running_sums(frame, ["g"], ["o"], F.col("v"), parts=7).collect()}
    want, total = {}, {}
    for g, o, v in rows:
        total[g] = total.get(g, 0) + (v or 0)
        want[g, o] = (v, total[g])
    assert got == want
    assert prefix.running_sums(frame.filter("false"), ["g"], ["o"], F.col("v")).count() == 0


def test_no_partition_holds_a_hot_group(spark):
    frame = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    sizes = [r["count"] for r in prefix.dealt(frame, ["g"], ["o"], parts=16).groupBy("_part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * 4000 / 16


def test_limits_and_firsts(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 1, 3), ("c", 1, 11)], "g string, o int, v long")
    got = {(r["g"], r["o"], r["running"]) for r in prefix.over_limit(frame, ["g"], ["o"], F.col("v"), 9).collect()}
    assert got == {("a", 2, 10), ("c", 1, 11)}
    names = spark.createDataFrame([("z", "x", 3), ("z", "y", 1), ("z", "x", 0), ("z", "w", 2)], "g string, k string, o int")
    assert [(r["k"], r["place"]) for r in prefix.first_occurrences(names, ["g"], "k", "o").orderBy("place").collect()] == [("x", 0), ("y", 1), ("w", 2)]
