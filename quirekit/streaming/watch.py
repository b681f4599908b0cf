"""A folder of arriving tables, segmented and translated as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segment, translate

SCHEMA = "doc_key string, text string"


def watch(spark: SparkSession, source: str, records: str, checkpoint: str, factory: Callable[[], object] = translate.MockProvider, options: dict | None = None, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Segments every Parquet file (doc_key, text) that arrives in ``source`` and writes its records under ``records``, a folder a batch.

    A batch that runs again after a failure overwrites its own folder, so each file's records appear once."""
    policy = translate.OPTIONS | (options or {})

    def batch(rows: DataFrame, number: int) -> None:
        units = segment.segment_texts(rows, "doc_key", policy)
        made = translate.executed(units.dropDuplicates(["segment_id"]), factory, policy)  # equal texts share ids: one call, many records
        units.join(made, "segment_id").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{records}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def progress_events(records: DataFrame) -> DataFrame:
    """Finished units by document with the running count, in order: what a progress display reads."""
    from pyspark.sql import Window

    done = Window.partitionBy("doc_key").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    return records.select("doc_key", "order", F.upper("status").alias("event"), F.count("*").over(done).alias("completed"))

