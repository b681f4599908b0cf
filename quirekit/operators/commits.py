"""Replacing all rows of some jobs at once: each commit writes beside what is there and is published by one file.

A commit writes its rows to a folder of its own, partitioned by job, and a manifest that says which jobs it replaces (a job without rows is
replaced by none). It becomes version n + 1 by creating the pointer file of that number, which must not be there: of two writers that read version n one
fails, deletes what it wrote, and may read and try again. Readers fold the manifests up to the newest pointer: the last commit of each job is its
rows. Nothing is changed in place, so a reader never sees a half commit, and rows of two commits of one job never mix.

Defined results: a table without commits is empty, at version 0; rows of jobs that a commit doesn't name are refused before anything is written;
null and empty job ids are refused, since a folder can't be called so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import stores


class Conflict(Exception):
    """Another writer has published the version this one was to be."""


class Versions:
    """A table of rows by job under ``root``. ``schema`` is that of the rows, with the job's column in it."""

    def __init__(self, spark: SparkSession, root: str, schema: str, job: str = "job_id"):
        self.spark, self.root, self.job = spark, root.rstrip("/"), job
        self.schema = spark.createDataFrame([], schema).schema
        self.kind = self.schema[job].dataType.simpleString()

    @property
    def version(self) -> int:
        """The newest published version."""
        return max((int(n) for n in stores.names(self.spark, f"{self.root}/pointers") if n.isdigit()), default=0)

    def _writes(self, upto: int) -> list[tuple[int, str]]:
        """The published writes up to a version; a line each, not a row of data."""
        store, where = stores.hadoop(self.spark, f"{self.root}/pointers")
        if not store.exists(where):
            return []
        rows = self.spark.read.text(f"{self.root}/pointers/*[0-9]", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int").alias("n"), "value").collect()
        return sorted((r["n"], r["value"]) for r in rows if r["n"] <= upto)

    def manifest(self, upto: int | None = None) -> DataFrame:
        """(job, write, version): where the rows of each job are."""
        writes = self._writes(self.version if upto is None else upto)
        known = self.spark.createDataFrame(writes, "version int, write string")
        if not writes:
            return known.select(F.lit(None).cast(self.kind).alias(self.job), "write", "version")
        named = self.spark.read.schema(f"`{self.job}` {self.kind}, write string").parquet(f"{self.root}/manifests")
        return last_writes(named.join(F.broadcast(known), "write"), self.job)  # a line a commit

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows as of a version, the newest by default."""
        where = self.manifest(upto)
        if not stores.names(self.spark, f"{self.root}/data"):
            return self.spark.createDataFrame([], self.schema)
        whole = StructType([*self.schema.fields, StructField("write", StringType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.root}/data")
        return rows.join(where.select(self.job, "write"), [self.job, "write"]).select(*[F.col(f"`{c}`") for c in self.schema.names])

    def commit(self, rows: DataFrame, replaced: DataFrame, read_at: int) -> int:
        """Replaces the rows of the jobs ``replaced`` names by ``rows``, as version ``read_at`` + 1. Raises Conflict, and leaves nothing, where that
        version is there already."""
        write = uuid.uuid4().hex
        named = replaced.select(F.col(self.job).cast(self.kind).alias(self.job)).distinct()
        if not named.filter(F.col(self.job).isNull() | (F.col(self.job).cast("string") == "")).isEmpty() or not rows.select(self.job).join(named, self.job, "left_anti").isEmpty():
            raise ValueError("INVALID_STATE: rows of jobs that the commit doesn't replace")
        own = [f"{self.root}/data/write={write}", f"{self.root}/manifests/write={write}"]
        try:
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).write.partitionBy(self.job).parquet(own[0])
            named.write.parquet(own[1])
            published = stores.created(self.spark, f"{self.root}/pointers/{read_at + 1:012}", write)
        except BaseException:
            for path in own:
                stores.removed(self.spark, path)
            raise
        if not published:
            for path in own:
                stores.removed(self.spark, path)
            raise Conflict(f"version {read_at + 1}")
        return read_at + 1

    def replace(self, jobs: DataFrame, make, tries: int = 5) -> int:
        """Commits ``make(rows now)`` for ``jobs``, reading anew after each conflict."""
        for _ in range(tries):
            now = self.version
            try:
                return self.commit(make(self.read(now)), jobs, now)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")


def last_writes(named: DataFrame, job: str) -> DataFrame:
    """(job, write, version) of the last of each job's writes (job, write, version)."""
    return named.groupBy(job).agg(F.max_by("write", "version").alias("write"), F.max("version").alias("version"))
