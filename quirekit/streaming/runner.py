"""Jobs from queue to end: a stateful stream claims them, orders their steps and folds what comes back; steps run as DataFrames.

Messages (submissions, control requests, results of steps) are files of one folder. A stream keyed by job keeps each job's small state and answers
every message with events (the job's or a step's new status) and at most one order: a step to run. A micro-batch's answers are written first; then all
its orders of one step run together, as one DataFrame through that step's handler, and their results are written as messages, which the next
batch reads. So thousands of jobs advance step by step, each step one Spark job over all of them.

A batch that runs again overwrites its own files, and the state takes every message once: a result counts only for the step and try it was ordered
for, so repeats are refused. A step whose result doesn't come within ``patience`` was interrupted: a timer fails it and its job, which a retry
request queues again. Pauses and cancellations of running jobs take effect when their step ends.

Defined results: messages of unknown kinds, of jobs never submitted, and moves the table of transitions doesn't allow, are events of status
``refused`` and change nothing. Messages of one job in one batch are taken in the order of ``at``, then of kind, step and try. Null ids are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schemas import CANCELLED, FAILED, JOB_MOVES, PARTIAL, PIPELINES, SUCCEEDED
from ..session import shipped

SUBMIT, CONTROL, RESULT, EXPIRED = "submit", "control", "result", "expired"
EVENT, ORDER, REFUSED = "event", "order", "refused"
MESSAGES = "job_id string, kind string, word string, step string, try int, outputs array<string>, code string, at timestamp"
ANSWERS = "job_id string, seq long, kind string, status string, step string, try int, code string"
_TOLD = pa.schema([("job_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("status", pa.string()), ("step", pa.string()), ("try", pa.int32()), ("code", pa.string())])


class JobRun:
    """One job's state, and what a message does to it. ``answers`` are (kind, status, step, try, code).

    A submission's word is its pipeline, a control request's what is asked, a result's the status of its step."""

    def __init__(self, held: str | None = None):
        self.pipeline, self.status, self.request, self.at, self.tries, self.seq = None, None, None, 0, 0, 0
        self.steps: list[str] = []
        self.answers: list[tuple] = []
        if held:
            self.pipeline, self.status, self.request, self.at, self.tries, self.seq, self.steps = json.loads(held)

    def held(self) -> str:
        return json.dumps([self.pipeline, self.status, self.request, self.at, self.tries, self.seq, self.steps])

    @property
    def step(self) -> str | None:
        names = PIPELINES.get(self.pipeline, ())
        return names[self.at][0] if self.at < len(names) else None

    def take(self, kind: str, word: str | None, step: str | None = None, number: int | None = None, code: str | None = None) -> None:
        before = self.status
        if kind == SUBMIT and before is None and word in PIPELINES:
            self.pipeline, self.status, self.steps = word, "queued", ["pending"] * len(PIPELINES[word])
            self._event("queued")
            self._claim()
        elif kind == CONTROL and before is not None and self._controlled(word):
            pass
        elif kind == RESULT and before in ("running", "cancelling") and (step, number) == (self.step, self.tries) and word in (SUCCEEDED, PARTIAL, FAILED, CANCELLED):
            self._ended(word, code)
        elif kind == EXPIRED and before in ("running", "cancelling") and (step, number) == (self.step, self.tries):
            self._ended(FAILED, "PROCESS_INTERRUPTED")
        elif kind != EXPIRED:
            self.answers.append((REFUSED, before, step, number, f"{kind}:{word}"))

    def _event(self, status: str, step: str | None = None, code: str | None = None) -> None:
        self.answers.append((EVENT, status, step, self.tries if step else None, code))

    def _move(self, status: str, code: str | None = None) -> bool:
        if status not in JOB_MOVES[self.status]:
            return False
        self.status = status
        self._event(status, code=code)
        return True

    def _claim(self) -> None:
        """A queued job runs at once; what it has done stays done."""
        self._move("running")
        self.at = next((i for i, s in enumerate(self.steps) if s != SUCCEEDED), len(self.steps))
        self._go_on()

    def _go_on(self) -> None:
        if self.step is None:
            self._move(PARTIAL if PARTIAL in self.steps else SUCCEEDED)
            return
        self.tries += 1
        self.steps[self.at] = "running"
        self._event("running", self.step)
        self.answers.append((ORDER, self.status, self.step, self.tries, None))

    def _ended(self, status: str, code: str | None) -> None:
        self.steps[self.at] = status
        self._event(status, self.step, code)
        if status == FAILED:
            self.request = None
            self._move(FAILED, code)
        elif self.request == "cancel" or status == CANCELLED:
            self.request = None
            if self.status == "running":
                self._move("cancelling")
            self._move(CANCELLED)
        else:
            self.at += 1
            if self.request == "pause" and self.step is not None:
                self.request = None
                self._move("paused")
            else:
                self.request = None
                self._go_on()

    def _controlled(self, word: str | None) -> bool:
        if word == "pause":
            if self.status == "running" and self.request is None:
                self.request = "pause"
                return True
            return self.status == "queued" and self._move("paused")
        if word == "cancel":
            if self.status == "running":
                self.request = "cancel"
                return self._move("cancelling")
            return self.status in ("queued", "paused") and self._move(CANCELLED)
        if word == "resume" and self.status == "paused" or word == "retry" and self.status in (FAILED, PARTIAL):
            self._move("queued")
            if word == "retry":
                first = next((i for i, s in enumerate(self.steps) if s in (FAILED, PARTIAL, CANCELLED)), len(self.steps))
                self.steps[first:] = ["pending"] * (len(self.steps) - first)
            self._claim()
            return True
        return False


class JobRuns(StatefulProcessor):
    """The stream's side of ``JobRun``: its state in the state store, and a timer for each ordered step."""

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "held string, due long")

    def _answered(self, key, run: JobRun, now: int) -> Iterator[pd.DataFrame]:
        ordered = [a for a in run.answers if a[0] == ORDER]
        waiting = run.status in ("running", "cancelling") and run.step is not None
        had = self.state.get()[1] if self.state.exists() else None
        due = had
        if self.patience is not None and (ordered or not waiting):
            if had is not None:
                self.handle.deleteTimer(had)
            due = now + int(self.patience * 1000) if waiting else None
            if due is not None:
                self.handle.registerTimer(due)
        rows = [(key[0], run.seq + i, *a) for i, a in enumerate(run.answers)]
        run.seq += len(rows)
        self.state.update((run.held(), due))
        yield pd.DataFrame(rows, columns=["job_id", "seq", "kind", "status", "step", "try", "code"]).astype({"try": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = JobRun(self.state.get()[0] if self.state.exists() else None)
        whole = pd.concat(list(rows))
        none = lambda x: None if pd.isna(x) else x
        for r in sorted(whole.itertuples(index=False), key=lambda r: (pd.isna(r.at), r.at, r.kind or "", r.step or "", 0 if pd.isna(r[4]) else r[4], r.word or "")):
            run.take(r.kind, r.word, r.step, none(r[4]), r.code)
        yield from self._answered(key, run, timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        run = JobRun(self.state.get()[0])
        run.take(EXPIRED, None, run.step, run.tries)
        yield from self._answered(key, run, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to messages that come job by job, in order: one job is held at a time, however many messages it has."""
    job, run = None, JobRun()
    names = [f.name for f in _TOLD]
    for batch in batches:
        out: list[tuple] = []
        for key, kind, word, step, number, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != job:
                job, run = key, JobRun()
            run.take(kind, word, step, number, code)
            out += [(key, i, *a) for i, a in enumerate(run.answers, run.seq)]
            run.seq += len(run.answers)
            run.answers.clear()
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOLD, strict=True)], names)


def answers(messages: DataFrame, patience: float | None = None) -> DataFrame:
    """Events and orders of a stream, or of a whole table, of messages. ``patience`` (seconds) sets timers, which only a stream has.

    A table holds all of a job's messages, so its runs are folded from sorted rows and need no state store, whose calls cost milliseconds a job."""
    shipped(messages.sparkSession)
    known = messages.filter(F.col("job_id").isNotNull())
    if not messages.isStreaming:
        blank = lambda name: F.coalesce(name, F.lit(""))
        order = [F.col("at").asc_nulls_last(), blank("kind"), blank("step"), F.coalesce("try", F.lit(0)), blank("word"), blank("code")]
        rows = known.repartition("job_id").sortWithinPartitions("job_id", *order)
        return rows.select("job_id", "kind", "word", "step", "try", "code").mapInArrow(_told, ANSWERS)
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return known.groupBy("job_id").transformWithStateInPandas(JobRuns(patience), ANSWERS, "append", "processingTime" if patience is not None else "none")


def message(job: str | None = None, kind: str = SUBMIT, word: str | None = None) -> tuple:
    """A message's values but for its time."""
    return job, kind, word, None, None, None, None


def sent(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    """Adds messages, stamped now, to a runner's folder."""
    columns = "job_id string, kind string, word string, step string, try int, outputs array<string>, code string"
    spark.createDataFrame(rows, columns).coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/messages/sent")


def run_jobs(spark: SparkSession, folder: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], patience: float = 3600.0, seconds: float = 0) -> StreamingQuery:
    """Starts the runner over ``folder``: messages, events and the stream's checkpoint lie in it. It may be stopped, or die, at any point and be started again.

    A handler takes its orders (job_id, step, try) and answers (job_id, status, outputs, code); jobs it leaves out, and all of a handler
    that raises, have failed."""
    for name in ("messages/sent", "events"):
        _made(spark, f"{folder}/{name}")

    def batch(rows: DataFrame, number: int) -> None:
        at = f"{folder}/events/batch={number}"
        rows.write.mode("overwrite").parquet(at)  # before anything acts on them
        own = rows.sparkSession
        told = own.read.schema(ANSWERS).parquet(at)
        orders = told.filter(F.col("kind") == ORDER).select("job_id", "step", "try")
        for step in sorted(r["step"] for r in orders.select("step").distinct().collect()):  # a fixed list of steps
            mine = orders.filter(F.col("step") == step)
            to = f"{folder}/messages/results-{number}-{step}"
            try:
                _results(mine, handlers[step](mine)).write.mode("overwrite").parquet(to)
            except Exception as e:  # noqa: BLE001  a step that can't run fails its jobs, not the runner
                none = own.createDataFrame([], "job_id string, status string, outputs array<string>, code string")
                _results(mine, none, type(e).__name__).write.mode("overwrite").parquet(to)

    source = spark.readStream.schema(MESSAGES).option("recursiveFileLookup", "true").parquet(f"{folder}/messages")
    writer = answers(source, patience).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def _made(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def _results(orders: DataFrame, done: DataFrame, error: str = "OUTPUT_MISSING") -> DataFrame:
    """Messages with the results of all orders; those that ``done`` lacks have failed."""
    found = done.select("job_id", F.col("status").alias("word"), "outputs", "code").dropDuplicates(["job_id"])
    out = orders.join(found, "job_id", "left")
    code = F.when(F.col("word").isNull(), error).otherwise(F.col("code"))
    return out.select("job_id", F.lit(RESULT).alias("kind"), F.coalesce("word", F.lit(FAILED)).alias("word"), "step", "try", "outputs", code.alias("code"), F.current_timestamp().alias("at"))


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, seq, status, code) of the jobs' own events, as ``jobs.folded`` takes them."""
    rows = spark.read.schema(ANSWERS + ", batch long").parquet(f"{folder}/events")
    return rows.filter((F.col("kind") == EVENT) & F.col("step").isNull()).select("job_id", "seq", "status", "code")


def step_events(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, seq, step, try, status, code) of the steps."""
    rows = spark.read.schema(ANSWERS + ", batch long").parquet(f"{folder}/events")
    return rows.filter((F.col("kind") == EVENT) & F.col("step").isNotNull()).select("job_id", "seq", "step", "try", "status", "code")


def settled(query: StreamingQuery, idle: int = 2) -> int:
    """Waits for so many batches without a message, one after the other, then stops the query; the number of its last batch.

    A stream with timers never runs out of batches by itself. A job whose order is still out has its result in the very next batch, since results
    are written before a batch ends."""
    empty, seen = 0, -1
    while empty < idle:
        if query.awaitTermination(0.05):  # raises what ended it
            return seen
        for p in query.recentProgress:
            if p["batchId"] > seen:
                seen, empty = p["batchId"], 0 if p["numInputRows"] else empty + 1
    query.stop()
    return seen


def drained(spark: SparkSession, folder: str, handlers: dict, patience: float = 3600.0) -> int:
    """Runs until no message is left."""
    return settled(run_jobs(spark, folder, handlers, patience))
