"""The state of a workspace: counts, health of its parts, and whether its tables and its payload store agree.

All references are reconciled at once: every table says, as tagged rows, which keys it has and which it needs (and the store which files it
has, of what size), and one grouping by kind and key tells what is missing, altered or left over. Repeats combine before the shuffle, so a key that
a third of all rows need is one row a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores

#: What a table needs of another: table, its column, kind of the key, what is wrong where it is missing.
NEEDS = (
    ("jobs", "project_id", "project", "PROJECT_MISSING"),
    ("artifacts", "project_id", "project", "PROJECT_MISSING"),
    ("sources", "project_id", "project", "PROJECT_MISSING"),
    ("sources", "artifact_id", "artifact", "ARTIFACT_MISSING"),
    ("segments", "job_id", "job", "JOB_MISSING"),
)
#: Tables and the columns that are their keys.
HAS = (("projects", "project_id", "project"), ("jobs", "job_id", "job"), ("artifacts", "artifact_id", "artifact"))
MISSING, ALTERED, ORPHAN = "PAYLOAD_MISSING", "PAYLOAD_ALTERED", "PAYLOAD_ORPHAN"


def _tagged(rows: DataFrame, kind: str, key: str, has: bool, size: Column | None = None, code: str | None = None) -> DataFrame:
    none = F.lit(None)
    side = lambda on: (size if size is not None else none).cast("long") if on else none.cast("long")
    return rows.filter(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.lit(int(has)).alias("has"), F.lit(int(not has)).alias("needs"), side(has).alias("had_size"), side(not has).alias("needed_size"), F.lit(code).cast("string").alias("code"))


def reconciled(tables: Mapping[str, DataFrame], files: DataFrame) -> DataFrame:
    """(kind, key, code, references) of what doesn't agree in tables (projects, jobs, artifacts with storage_key and size, sources, segments) and
    files (storage_key, size). Null keys refer to nothing."""
    parts = [_tagged(tables[name], kind, key, True) for name, key, kind in HAS]
    parts += [_tagged(tables[name], kind, key, False, code=code) for name, key, kind, code in NEEDS]
    parts += [_tagged(files, "payload", "storage_key", True, F.col("size")), _tagged(tables["artifacts"], "payload", "storage_key", False, F.col("size"), MISSING)]
    keys = reduce(DataFrame.unionByName, parts).groupBy("kind", "key").agg(
        F.sum("has").alias("has"), F.sum("needs").alias("references"), F.max("had_size").alias("had"), F.min("needed_size").alias("least"), F.max("needed_size").alias("most"), F.max("code").alias("code")
    )
    payload = F.col("kind") == "payload"
    wrong = F.when(F.col("has") == 0, F.col("code")).when(payload & (F.col("references") == 0), ORPHAN).when(payload & ((F.col("least") != F.col("had")) | (F.col("most") != F.col("had"))), ALTERED)
    return keys.withColumn("code", wrong).filter("code is not null").select("kind", "key", "code", "references")


def summary(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: projects, jobs and active jobs."""
    active = F.count_if(F.col("status").isin("queued", "running", "cancelling"))
    return projects.agg(F.count("*").alias("projects")).join(jobs.agg(F.count("*").alias("jobs"), active.alias("active_jobs")))  # one row each


def writable(spark: SparkSession, folder: str) -> tuple[bool, str]:
    """Whether a file can be created in a folder and deleted again."""
    path = f"{folder.rstrip('/')}/_probe-{uuid.uuid4().hex}"
    try:
        fine = stores.created(spark, path, "")
        stores.removed(spark, path)
    except Exception as e:  # noqa: BLE001  a check tells, it doesn't fail
        return False, type(e).__name__
    return fine, folder


def report(spark: SparkSession, folder: str, wrong: DataFrame, providers: Mapping[str, str] = {}, adapters: Mapping[str, str] = {}, required: tuple[str, ...] = ("mock",)) -> DataFrame:
    """(name, ok, detail, optional) of all checks: the folder, the tables' integrity by code, and the health that registries told. Providers and
    adapters are optional unless they are required."""
    fine, detail = writable(spark, folder)
    rows = [("data_directory", fine, detail, False)]
    for kind, health in (("provider", providers), ("adapter", adapters)):
        rows += [(f"{kind}:{name}", told == "ok", told, name not in required) for name, told in sorted(health.items())]
    told = spark.createDataFrame(rows, "name string, ok boolean, detail string, optional boolean")
    n = wrong.groupBy("code").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    broken = n.select(F.concat(F.lit("integrity:"), "code").alias("name"), F.lit(False).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(", first "), "first").alias("detail"), (F.col("code") == ORPHAN).alias("optional"))
    return told.unionByName(broken)


def healthy(checks: DataFrame) -> bool:
    """Whether all checks that aren't optional are well."""
    return checks.agg(F.coalesce(F.bool_and(F.col("ok") | F.col("optional")), F.lit(True)).alias("ok")).first()["ok"]
