"""Jobs as tables: state folds over events, progress, listings, claims and controls."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FINAL_JOB, JOB_MOVES, PIPELINES, STEP_MOVES


def pipeline_steps(spark) -> DataFrame:
    """(pipeline, position, step, weight) of the preset pipelines."""
    rows = [(name, i, step, weight) for name, steps in PIPELINES.items() for i, (step, weight) in enumerate(steps)]
    return spark.createDataFrame(rows, "pipeline string, position int, step string, weight double")


def default_pipeline(kind: str, source_kind: str) -> str:
    """Pipeline of a project by its kind and that of its source."""
    if kind == "manga":
        return "manga_full_v1"
    return "novel_epub_v1" if source_kind == "epub" else "novel_txt_v1"


def exploded_steps(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """A pending step run for each step of each job's pipeline."""
    return jobs.join(F.broadcast(steps), "pipeline").withColumn("step_status", F.lit("pending"))  # a fixed table of presets


def folded(events: DataFrame, key: str = "job_id", seq: str = "seq", moves: dict | None = None) -> DataFrame:
    """Current status of each job from its events in order; moves the table of transitions doesn't allow are passed over and counted."""
    moves = moves or JOB_MOVES
    first = next(iter(moves))
    allowed = F.create_map(*chain.from_iterable((F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>")) for a, bs in moves.items()))
    history = F.sort_array(F.collect_list(F.struct(seq, "status")))

    def step(state: Column, event: Column) -> Column:
        fine = F.array_contains(F.coalesce(allowed[state["status"]], F.array().cast("array<string>")), event["status"])
        return F.struct(F.when(fine, event["status"]).otherwise(state["status"]).alias("status"), (state["refused"] + F.when(fine, 0).otherwise(1)).alias("refused"))

    state = F.aggregate(history, F.struct(F.lit(first).alias("status"), F.lit(0).alias("refused")), step)
    return events.groupBy(key).agg(state.alias("state")).select(key, "state.status", "state.refused", F.col("state.status").isin(*FINAL_JOB).alias("final"))


def folded_steps(events: DataFrame, key: str = "step_id", seq: str = "seq") -> DataFrame:
    return folded(events, key, seq, STEP_MOVES)


def progress(steps: DataFrame, job: str = "job_id") -> DataFrame:
    """Weighted progress: running counts partial steps and a share of the current one, retry only succeeded ones."""
    done = F.col("status").isin("succeeded", "partially_succeeded")
    current = F.when(F.col("status") == "running", F.col("weight") * F.least(F.greatest(F.col("progress"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return steps.groupBy(job).agg(
        F.least(F.lit(1.0), F.sum(F.when(done, F.col("weight")).otherwise(current))).alias("progress"),
        F.sum(F.when(F.col("status") == "succeeded", F.col("weight")).otherwise(0.0)).alias("retry_progress"),
        F.min(F.when(F.col("status").isin("failed", "partially_succeeded", "cancelled"), F.col("position"))).alias("restart_at"),
    )


def latest(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each group by an order; ties need a unique last column."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def claim(jobs: DataFrame, requested: str = "requested_at", job: str = "job_id") -> DataFrame:
    """The oldest queued job; a single writer commits it by appending its event."""
    return jobs.filter(F.col("status") == "queued").orderBy(requested, job).limit(1)


def controlled(status: Column, request: str) -> Column:
    """Status after a control request: queued jobs change at once, running ones at their next checkpoint."""
    if request == "pause":
        return F.when(status == "queued", "paused").otherwise(status)
    if request == "cancel":
        return F.when(status.isin("queued", "paused"), "cancelled").when(status == "running", "cancelling").otherwise(status)
    if request == "resume":
        return F.when(status == "paused", "queued").otherwise(status)
    raise ValueError(f"unknown control request: {request}")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs found running at a start were interrupted: they fail, and can be retried."""
    hit = F.col("status").isin("running", "cancelling")
    return jobs.withColumn("error_code", F.when(hit, "PROCESS_INTERRUPTED")).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def retried(steps: DataFrame, job: str = "job_id") -> DataFrame:
    """Steps from the first failed, partial or cancelled one on are pending again."""
    start = F.min(F.when(F.col("status").isin("failed", "partially_succeeded", "cancelled"), F.col("position"))).over(Window.partitionBy(job))
    return steps.withColumn("_start", start).withColumn("status", F.when(F.col("position") >= F.col("_start"), "pending").otherwise(F.col("status"))).drop("_start")


def listed(rows: DataFrame, order: list[Column], **filters) -> DataFrame:
    """Rows that meet the filters that were given, in order."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows.orderBy(*order)


def ordered_lookup(ids: list, rows: DataFrame, key: str) -> DataFrame:
    """Rows by a list of ids, in the list's order with its repeats; unknown ids drop out."""
    kind = dict(rows.dtypes)[key]
    wanted = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {kind}")
    return wanted.join(rows, key).orderBy("pos")


def deletion_impact(projects: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """What a deletion would take, and whether an active job forbids it."""
    active = F.count_if(F.col("status").isin("queued", "running", "paused", "cancelling"))
    per = jobs.groupBy(key).agg(F.count("*").alias("jobs"), active.alias("active"))
    return projects.select(key).join(per, key, "left").select(key, F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("active", F.lit(0)).alias("active"), (F.coalesce("active", F.lit(0)) == 0).alias("deletable"))
