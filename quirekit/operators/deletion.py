"""Deleting projects and sweeping the payload store: mark what nothing refers to, wait, look again, delete.

Payloads are stored once under their checksum and may be shared, so a project's payloads go only when no other artifact refers to them. The mark is a
table of candidates; the sweep, any time later, anti-joins it with the references of that moment, so a payload that was used again in between
stays. Files are deleted by tasks, and both phases can be broken off and run again.

Defined results: artifacts without a storage key refer to nothing; a null project id owns nothing. Files of unfinished writers are candidates
once they are older than the grace period, as are payloads that nothing has referred to: one just written may not have its row yet.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources import stores
from . import jobs

#: How old an unreferenced file must be.
GRACE = timedelta(hours=24)


def impact(project_id, owned: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table that a deletion would take."""
    return {name: rows.filter(F.col("project_id") == project_id).count() for name, rows in owned.items()}


def without_project(tables: dict[str, DataFrame], project_id, confirmed: bool = False) -> dict[str, DataFrame]:
    """``tables`` (projects, jobs with their status, artifacts and others, all with project_id) without one project. Refuses an unknown
    project, one with an active job, and a deletion that isn't confirmed, naming what it would take."""
    facts = jobs.deletion_impact(tables["projects"].filter(F.col("project_id") == project_id), tables["jobs"], "project_id").first()
    if facts is None:
        raise ValueError("NOT_FOUND: project")
    if not confirmed:
        raise ValueError(f"INVALID_STATE: the deletion needs confirmation: {impact(project_id, {n: t for n, t in tables.items() if n != 'projects'})}")
    if not facts["deletable"]:
        raise ValueError(f"INVALID_STATE: {facts['active']} active jobs; cancel them first")
    return {name: rows.filter(~F.coalesce(F.col("project_id") == project_id, F.lit(False))) for name, rows in tables.items()}


def garbage(files: DataFrame, artifacts: DataFrame, had: DataFrame | None = None, now: Column | None = None, grace: timedelta = GRACE) -> DataFrame:
    """(storage_key, size, reason) of files (storage_key, size, modified, pending) that no artifact refers to.

    ``had`` are artifacts that were deleted just now: what only they referred to is ``deleted``, at once. The rest must be older than ``grace``:
    ``pending`` or ``orphan``. Joins are by key on both sides, neither is collected."""
    live = artifacts.select("storage_key").filter("storage_key is not null").distinct()
    free = files.join(live, "storage_key", "left_anti")
    if had is None:
        free = free.withColumn("was", F.lit(False))
    else:
        free = free.join(had.select("storage_key").filter("storage_key is not null").distinct().withColumn("was", F.lit(True)), "storage_key", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    old = F.col("modified") < (now if now is not None else F.current_timestamp()) - F.lit(grace)
    reason = F.when(F.col("was"), "deleted").when(old & F.col("pending"), "pending").when(old, "orphan")
    return free.withColumn("reason", reason).filter("reason is not null").select("storage_key", "size", "reason")


def marked(files: DataFrame, artifacts: DataFrame, had: DataFrame | None = None, folder: str | None = None, grace: timedelta = GRACE) -> DataFrame:
    """The candidates as a written table: the first phase."""
    return written(garbage(files, artifacts, had, grace=grace), "marks", folder)


def swept(marks: DataFrame, artifacts: DataFrame, folder: str) -> DataFrame:
    """(storage_key, outcome) of the second phase: of the marks, what nothing refers to now is deleted, the rest is ``kept``."""
    live = artifacts.select("storage_key").filter("storage_key is not null").distinct().withColumn("live", F.lit(True))
    looked = marks.select("storage_key").distinct().join(live, "storage_key", "left")
    gone = stores.deleted(looked.filter("live is null"), folder)
    return written(gone.unionByName(looked.filter("live").select("storage_key", F.lit("kept").alias("outcome"))), "sweep")
