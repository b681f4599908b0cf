"""Connected components by repeated minima and pointer jumping, in tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b): the least vertex of its component.

    Each round a vertex takes the least label among its own, its neighbours' and its label's label, so rounds grow with the
    logarithm of a component's diameter in practice."""
    both = written(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", files=files)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels", files=files)
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("w"), F.col("label").alias("above"))
        step = lower.join(up, F.col("label") == F.col("w"), "left").select("v", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        after = written(step, "labels", files=files)
        moved = after.filter("old <> label").limit(1).count()
        dropped(labels)
        labels = after.select("v", "label")
        if not moved:
            dropped(both)
            return labels
