"""Translate steps that lose no finished call: a log of calls, records folded from it, and progress events.

The stage that asks the provider has two outputs. Its records go on in the frame; each finished call, with the events that led to it (retries, then its
end), goes to a log at once: a task writes small files of its own folder, each published whole by a rename. A task that is killed leaves its log;
the next attempt of the same task reads it first and asks only for what is missing. A step that is started again folds the whole log (the
last call of each segment counts) and asks only for segments that aren't done.

Log folders are named by run and task, so that an attempt reads no more than its own part. The log must lie where tasks can write files: a
local or mounted path, or a store that Arrow's file systems know.

Defined results: null ids are dropped; rows of equal ids share one call; a null text is an empty one. Calls after a cancellation are ``cancelled``
records without an attempt, and are asked again by a later run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CANCELLED, DONE, ERROR, FAILED, PARTIAL, SUCCEEDED
from ..session import shipped, written
from . import translate

_RECORD = f"segment_id string, status string, translated_text string, provider_id string, model string, attempts int, usage map<string,bigint>, error {ERROR}"
_EVENTS = "events array<struct<kind:string,attempt:int,at:double,code:string>>"
LOG = f"{_RECORD}, {_EVENTS}"
_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("segment_id", "status", "translated_text", "provider_id", "model")],
        ("attempts", pa.int32()),
        ("usage", pa.map_(pa.string(), pa.int64())),
        ("error", pa.struct([("code", pa.string()), ("message", pa.string()), ("details", pa.string()), ("retryable", pa.bool_())])),
        ("events", pa.list_(pa.struct([("kind", pa.string()), ("attempt", pa.int32()), ("at", pa.float64()), ("code", pa.string())]))),
    ]
)
STARTED, PROGRESS, RETRY, COMPLETED = "started", "progress", "retry", "completed"


class CallLog:
    """A task's part of the log: files of finished calls, whole or not there."""

    def __init__(self, folder: str, run: str, task: int):
        if "://" in folder or folder.startswith("file:"):
            self.store, root = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
        else:
            self.store, root = fs.LocalFileSystem(), folder
        self.at = f"{root.rstrip('/')}/run={run}/task={task}"

    def finished(self) -> dict[str, dict]:
        """The calls that earlier attempts of this task have logged, by segment."""
        out = {}
        for file in sorted(f.path for f in self.store.get_file_info(fs.FileSelector(self.at, allow_not_found=True)) if f.path.endswith(".parquet")):
            if not file.rsplit("/", 1)[1].startswith("_"):
                out |= {r["segment_id"]: r for r in pq.read_table(file, schema=_ARROW, filesystem=self.store, partitioning=None).to_pylist()}
        return out

    def add(self, calls: list[dict]) -> None:
        self.store.create_dir(self.at, recursive=True)
        name = f"{time.time_ns():020}-{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_pylist(calls, _ARROW), f"{self.at}/_{name}", filesystem=self.store)
        self.store.move(f"{self.at}/_{name}", f"{self.at}/{name}")


def asked(work: DataFrame, factory: Callable[[], object], folder: str, run: str, options: dict | None = None, token=None, protected: tuple[str, ...] = (), every: int = 16) -> DataFrame:
    """Records of ``work`` (segment_id, source_text; distinct ids), each call logged in ``folder`` before its task goes on, ``every`` so many at once.

    ``work`` must give each task the same rows again, as a written table does."""
    policy = translate.OPTIONS | (options or {})
    shipped(work.sparkSession)

    def stage(frames):
        log, provider, fresh = CallLog(folder, run, TaskContext.get().partitionId()), None, []
        had = log.finished()
        for frame in frames:
            rows = []
            for key, text in zip(frame["segment_id"], frame["source_text"], strict=True):
                if key in had:
                    rows.append(had[key] | {"usage": dict(had[key]["usage"] or {})})
                    continue
                if token is not None and token.cancelled:
                    rows.append({"segment_id": key, "status": CANCELLED, "translated_text": None, "provider_id": None, "model": None, "attempts": 0, "usage": {}, "error": {"code": "CANCELLED", "message": "the step was cancelled", "details": "{}", "retryable": False}, "events": [{"kind": CANCELLED, "attempt": 0, "at": time.time(), "code": "CANCELLED"}]})
                    continue
                provider = provider or factory()
                events: list[dict] = []
                note = lambda kind, attempt, error, events=events: events.append({"kind": kind, "attempt": attempt, "at": time.time(), "code": (error or {}).get("code")})
                call = translate.called(provider, text or "", policy, protected, note=note)
                rows.append({"segment_id": key, "provider_id": getattr(provider, "id", ""), **call, "events": events})
                fresh.append(rows[-1])
                if len(fresh) >= every:
                    log.add(fresh)
                    fresh = []
            yield pd.DataFrame(rows, columns=_ARROW.names)
        if fresh:
            log.add(fresh)

    return work.select("segment_id", "source_text").mapInPandas(stage, LOG)


def logged(spark: SparkSession, folder: str) -> DataFrame:
    """The last logged call of each segment, over all runs."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(base):
        return spark.createDataFrame([], LOG)
    calls = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(folder)
    last = F.max_by(F.struct(*calls.columns), F.element_at("events", -1)["at"])
    return calls.groupBy("segment_id").agg(last.alias("call")).select("call.*")


def resumed(segments: DataFrame, folder: str, factory: Callable[[], object], options: dict | None = None, token=None, by: list[str] | None = None, every: int = 16) -> tuple[DataFrame, DataFrame]:
    """A translate step that goes on where it stopped: (records, status).

    Records are the rows of ``segments`` (segment_id, source_text and any others, as document and order) with their results, whether a run before or
    this one got them. Status is that of all of them, by the columns ``by`` (or in one row). Done calls in the log aren't made again."""
    spark = segments.sparkSession
    segments = written(segments.filter("segment_id is not null"), "segments")  # their plan runs once
    had = logged(spark, folder).filter(F.col("status").isin(*DONE))
    had = written(had.join(segments.select("segment_id").distinct(), "segment_id", "left_semi"), "calls", files=64)
    todo = segments.select("segment_id", "source_text").join(had.select("segment_id"), "segment_id", "left_anti").dropDuplicates(["segment_id"])
    todo = written(todo, "work")  # each task gets the same rows again
    made = written(asked(todo, factory, folder, uuid.uuid4().hex, options, token, every=every), "records")
    results = had.withColumn("reused", F.lit(True)).unionByName(made.withColumn("reused", F.lit(False)))
    records = segments.join(results, "segment_id")
    status = records.groupBy(*(by or [])).agg(step_status().alias("status"), F.count("*").alias("selected"), F.count_if(~F.col("reused")).alias("worked"))
    return records, status


def step_status() -> Column:
    """Status of a step by all its records: cancelled or failed ones leave it partly done if any is done."""
    s = F.col("status")
    every, good, gone = F.count(F.lit(1)), F.count_if(s.isin(*DONE)), F.count_if(s == CANCELLED)
    return F.when(good == every, SUCCEEDED).when(good > 0, PARTIAL).when(gone > 0, CANCELLED).otherwise(FAILED)


def progress_events(records: DataFrame, by: str) -> DataFrame:
    """(by, seq, event_id, kind, completed, total, segment_id, attempt, message) of all seven kinds, from records with their events.

    A batch starts, its calls retry and end, each end is followed by the progress so far, and it completes with its status. Ends are in the
    order of their times, then ids. An event's id is a hash of what it tells, so one that is told twice is the same."""
    calls = records.filter(F.size("events") > 0).select(by, "segment_id", "status", F.posexplode("events").alias("n", "e"), (F.size("events") - 1).alias("last"))
    calls = calls.select(by, "segment_id", "e.kind", "e.attempt", "e.at", F.col("e.code").alias("message"), (F.col("n") == F.col("last")).alias("ends"))
    order = Window.partitionBy(by).orderBy("at", "segment_id", "attempt", F.col("kind") != RETRY)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = calls.withColumn("ended", F.sum(F.col("ends").cast("long")).over(upto)).withColumn("place", F.row_number().over(order).cast("long"))
    totals = records.groupBy(by).agg(F.count_if(F.size("events") > 0).alias("total"), step_status().alias("status"))
    whole = counted.join(totals.select(F.col(by).alias("_of"), "total"), F.col(by).eqNullSafe(F.col("_of")))
    row = lambda seq, kind, completed, total, segment=None, attempt=None, message=None: [
        seq.cast("long").alias("seq"),
        kind.alias("kind"),
        completed.cast("long").alias("completed"),
        total.cast("long").alias("total"),
        (F.lit(None) if segment is None else segment).cast("string").alias("segment_id"),
        (F.lit(None) if attempt is None else attempt).cast("int").alias("attempt"),
        (F.lit(None) if message is None else message).cast("string").alias("message"),
    ]
    total = F.col("total")
    before = F.col("ended") - F.col("ends").cast("long")
    told = whole.select(by, *row(F.col("place") * 2, F.col("kind"), before, total, F.col("segment_id"), F.col("attempt"), F.col("message")))
    steps = whole.filter("ends").select(by, *row(F.col("place") * 2 + 1, F.lit(PROGRESS), F.col("ended"), total, F.col("segment_id")))
    first = totals.select(by, *row(F.lit(0), F.lit(STARTED), F.lit(0), total, message=F.lit("translation")))
    last = totals.select(by, *row(F.lit((1 << 62) - 1), F.lit(COMPLETED), total, total, message=F.col("status")))
    out = told.unionByName(steps).unionByName(first).unionByName(last)
    key = F.sha2(F.to_json(F.struct(F.col(by).cast("string").alias("by"), "kind", "segment_id", "attempt"), {"ignoreNullFields": "false"}), 256)
    return out.withColumn("event_id", key)


def call_events(calls: DataFrame) -> DataFrame:
    """(event_id, at, segment_id, kind, attempt, message) of logged calls."""
    one = calls.select("segment_id", F.explode("events").alias("e"))
    key = F.sha2(F.concat_ws("\0", "segment_id", "e.kind", F.col("e.attempt").cast("string"), F.col("e.at").cast("string")), 256)
    return one.select(key.alias("event_id"), F.timestamp_micros((F.col("e.at") * 1e6).cast("long")).alias("at"), "segment_id", "e.kind", "e.attempt", F.col("e.code").alias("message"))


def event_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """The events of a log as they arrive. What a log tells twice, as where a batch was written again, comes once."""
    calls = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(folder)
    return call_events(calls).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
