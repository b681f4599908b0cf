"""The runtime around jobs: projects and jobs as appended rows, resumable steps, reuse and export of pages, nested loads, migrations.

Tables are append-only; a state is folded from events (``jobs``). What the driver does here is bounded by one project or one job; what
runs over segments, pages or events is a DataFrame.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..schemas import DONE, FAILED
from ..session import written
from . import jobs, translate

# Versions of the stored tables, in order.
TABLE_VERSIONS = (1, 2, 3)


class Cancelled(Exception):
    """A step was asked to stop and did, at a checkpoint."""


class CancellationToken:
    """A request to stop that tasks and driver see: an empty file in a folder they share."""

    def __init__(self, path: str):
        self.path = path

    def cancel(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path, "a"):
            pass

    @property
    def cancelled(self) -> bool:
        return os.path.exists(self.path)

    def checkpoint(self) -> None:
        if self.cancelled:
            raise Cancelled(self.path)


def checked_endpoint(url: str, allowed: tuple[str, ...] = ("http", "https")) -> str:
    """``url`` without its trailing slash; refuses other schemes, credentials, queries and fragments."""
    parts = urlsplit(url.strip())
    if parts.scheme not in allowed or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("CONFIGURATION: the endpoint must be a plain http or https address")
    return url.strip().rstrip("/")


def setting(name: str, default, kind: Callable = str, least: float = -math.inf, most: float = math.inf):
    """An environment variable as ``kind``, within bounds."""
    raw = os.environ.get(name)
    if raw is None or not raw.strip():
        return default
    try:
        value = kind(raw)
    except ValueError:
        raise ValueError(f"CONFIGURATION: {name} is no {kind.__name__}") from None
    if kind in (int, float) and not (math.isfinite(value) and least <= value <= most):
        raise ValueError(f"CONFIGURATION: {name} lies outside {least} to {most}")
    return value


def started_at(column: Column) -> Column:
    """A start that was noted, else now: the first claim sets it, later ones keep it."""
    return F.coalesce(column, F.current_timestamp())


def new_id() -> Column:
    """A random id. Not repeatable: give it to a row once, and store it."""
    return F.expr("uuid()")


def new_project(spark: SparkSession, name: str, kind: str, source: Mapping, policy: Mapping) -> dict[str, DataFrame]:
    """Rows to append for a project: itself, its source and its default profile. Refuses a bad name, kind, policy, or secrets in texts."""
    if kind not in ("novel", "manga") or not name.strip() or len(name) > 200:
        raise ValueError("CONFIGURATION: a project needs a name of at most 200 characters and a kind, novel or manga")
    values.check_policy(policy)
    if values.redacted_text(name) != name:
        raise ValueError("CONFIGURATION: the name holds a secret")
    project = spark.createDataFrame([(name.strip(), kind)], "name string, kind string").select(new_id().alias("project_id"), "name", "kind", F.current_timestamp().alias("created_at"))
    project = written(project, "project")  # its random id is drawn once
    key = project.select("project_id")
    sources = key.withColumn("source_sha256", F.lit(source["source_sha256"])).withColumn("filename", F.lit(source["filename"])).withColumn("source_size", F.lit(int(source["source_size"])).cast("long"))
    profile = key.withColumn("profile", F.lit("default")).withColumn("policy", F.lit(json.dumps(values.json_safe(dict(policy)), sort_keys=True)))
    return {"projects": project, "sources": sources, "profiles": profile}


def new_job(projects: DataFrame, profiles: DataFrame, pipeline: str) -> dict[str, DataFrame]:
    """Rows to append for one queued job of each project: the job with a snapshot of its profile, its steps and first event."""
    spark = projects.sparkSession
    steps = jobs.pipeline_steps(spark)
    if steps.filter(F.col("pipeline") == pipeline).isEmpty():
        raise ValueError(f"CONFIGURATION: unknown pipeline {pipeline}")
    made = projects.select("project_id").join(profiles.select("project_id", "policy"), "project_id").select(new_id().alias("job_id"), "project_id", F.lit(pipeline).alias("pipeline"), "policy", F.current_timestamp().alias("requested_at"))
    made = written(made, "jobs")
    events = made.select("job_id", F.lit(0).alias("seq"), F.lit("queued").alias("status"), F.col("requested_at").alias("at"))
    return {"jobs": made, "steps": jobs.exploded_steps(made.select("job_id", "pipeline"), steps), "events": events}


#: What stands for the project's own file among a step's inputs.
FILE = "source"
# What each step reads, in order. A pipeline has one of the two segmenting steps.
INPUTS = {
    "detect_encoding": (FILE,),
    "inspect_epub": (FILE,),
    "prepare_manga": (FILE,),
    "extract_text": (FILE, "detect_encoding"),
    "segment_text": ("extract_text",),
    "segment_epub": ("inspect_epub",),
    "translate_text": ("segment_text", "segment_epub"),
    "quality_check": ("translate_text",),
    "export_novel": ("translate_text", "quality_check"),
    "export_epub": ("inspect_epub", "translate_text", "quality_check"),
    "translate_manga": ("prepare_manga",),
    "export_manga": ("translate_manga",),
}


def step_inputs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """``runs`` (job_id, step, outputs) with ``inputs``: the artifacts each step reads, those of all its inputs one after the other, in order.

    ``sources`` has one (job_id, source_artifact) a job. A step that isn't in the job, or has put out nothing, adds nothing; an unknown
    step reads nothing. A job's few steps meet in one row, so this is one shuffle by job."""
    kind = dict(runs.dtypes)["outputs"]
    none = F.array().cast(kind)
    made = runs.groupBy("job_id").agg(F.collect_list(F.struct(*runs.columns)).alias("made")).join(sources.select("job_id", "source_artifact"), "job_id", "left")
    wanted = F.create_map(*[x for step, names in INPUTS.items() for x in (F.lit(step), F.array(*map(F.lit, names)))])

    def put_out(name: Column) -> Column:
        steps = F.flatten(F.transform(F.filter("made", lambda r: r["step"] == name), lambda r: F.coalesce(r["outputs"], none)))
        file = F.when(F.col("source_artifact").isNotNull(), F.array("source_artifact")).otherwise(none)
        return F.when(name == FILE, file).otherwise(steps)

    one = made.withColumn("run", F.explode("made"))
    inputs = F.flatten(F.transform(F.coalesce(wanted[F.col("run.step")], F.array().cast("array<string>")), put_out))
    return one.select("run.*", inputs.alias("inputs"))


def reused_pages(pages: DataFrame, artifacts: DataFrame, earlier: DataFrame) -> DataFrame:
    """``pages`` (project_id, page_id, order) with their source artifact and the translated artifact of an earlier job that was made from the
    same source artifact: then the page is reused, else it is to be translated."""
    source = artifacts.select("project_id", "page_id", F.col("artifact_id").alias("source_artifact_id"))
    made = earlier.groupBy("project_id", "source_artifact_id").agg(F.max_by("artifact_id", F.struct("created_at", "artifact_id")).alias("reused_artifact_id"))
    out = pages.join(source, ["project_id", "page_id"], "left").join(made, ["project_id", "source_artifact_id"], "left")
    return out.withColumn("action", F.when(F.col("source_artifact_id").isNull(), "missing").when(F.col("reused_artifact_id").isNotNull(), "reuse").otherwise("translate"))


def exported_pages(pages: DataFrame, translated: DataFrame) -> DataFrame:
    """(project_id, order, page_id, artifact_id, omitted): every page in order, with its translated artifact if it has one."""
    out = pages.join(translated.select("project_id", "page_id", "artifact_id"), ["project_id", "page_id"], "left")
    return out.select("project_id", "order", "page_id", "artifact_id", F.col("artifact_id").isNull().alias("omitted"))


def nested(parents: DataFrame, key: str, most: int | None = None, **children: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """``parents`` with an array of structs for each kind of child: (rows, columns, order). The array of one parent must fit a task;
    ``most`` refuses parents with more children, by error, instead of leaving any out."""
    out = parents
    for name, (rows, columns, order) in children.items():
        item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("item"))
        held = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"])
        per = rows.groupBy(key).agg((held if most is None else F.when(F.count("*") <= most, held).otherwise(F.raise_error(F.lit(f"TOO_MANY: {name}")))).alias(name))
        kind = dict(per.dtypes)[name]
        out = out.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def export_json(project: Column, profile: Column, manifest: Column, segments: Column, build: Column) -> Column:
    """The structured export of a text project, as one JSON text with nulls kept."""
    return F.to_json(F.struct(project.alias("project"), profile.alias("profile"), manifest.alias("manifest"), segments.alias("segments"), build.alias("build")), {"ignoreNullFields": "false"})


def deletable(projects: DataFrame, owned: dict[str, DataFrame], job_rows: DataFrame, project_id) -> dict[str, DataFrame]:
    """The tables without one project and what it owns. Refuses while a job of it is active."""
    impact = jobs.deletion_impact(projects.filter(F.col("project_id") == project_id), job_rows, "project_id").first()
    if impact is None:
        raise ValueError("PROJECT_NOT_FOUND")
    if not impact["deletable"]:
        raise ValueError(f"ACTIVE_JOBS: {impact['active']}")
    return {"projects": projects.filter(F.col("project_id") != project_id)} | {name: rows.filter(F.col("project_id") != project_id) for name, rows in owned.items()}


def migrated(rows: DataFrame, steps: Mapping[int, Callable[[DataFrame], DataFrame]], target: int = TABLE_VERSIONS[-1]) -> DataFrame:
    """``rows`` brought to version ``target`` by their ``schema_version``, one step after the other, never back. Rows of one version take each
    step together; a version above the target, or without a step, is refused when the rows are read."""
    known = F.col("schema_version").isNotNull() & F.col("schema_version").between(1, target)
    out = rows.withColumn("schema_version", F.when(known, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("UNSUPPORTED_SCHEMA: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))))))
    for version in range(1, target):
        if version not in steps:
            raise ValueError(f"MIGRATION_MISSING: {version}")
        old = steps[version](out.filter(F.col("schema_version") == version)).withColumn("schema_version", F.lit(version + 1))
        out = out.filter(F.col("schema_version") > version).unionByName(old, allowMissingColumns=True)
    return out


def retryable_batches(records: DataFrame, by: str) -> DataFrame:
    """(by, retryable, whole): whether any failure may be retried, and whether all records are done."""
    failed = F.col("status") == FAILED
    return records.groupBy(by).agg(F.coalesce(F.bool_or(F.when(failed, F.col("error.retryable"))), F.lit(False)).alias("retryable"), F.bool_and(F.col("status").isin(*DONE)).alias("whole"))


def reserved_parameters(parameters: Column, reserved=values.RESERVED) -> Column:
    """Names of a map of model parameters that a request sets itself, sorted."""
    return F.sort_array(F.array_intersect(F.map_keys(parameters), F.array(*[F.lit(x) for x in sorted(reserved)])))


class Registry:
    """Providers or adapters by name: made once a task, asked for their health on the driver, chosen by what they declare they can do."""

    def __init__(self):
        self._made: dict[str, tuple[Callable[[], object], frozenset[str]]] = {}

    def register(self, name: str, factory: Callable[[], object], capabilities: Iterable[str] = ()) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", name):
            raise ValueError("CONFIGURATION: a provider's name is lower-case letters, digits, - and _")
        if name in self._made:
            raise ValueError(f"CONFIGURATION: {name} is registered already")
        self._made[name] = factory, frozenset(capabilities)

    def factory(self, name: str, capability: str | None = None) -> Callable[[], object]:
        """The factory of a name, which must declare the capability where one is asked for."""
        if name not in self._made:
            raise ValueError(f"PROVIDER_NOT_FOUND: {name}")
        made, known = self._made[name]
        if capability is not None and capability not in known:
            raise ValueError(f"CONFIGURATION: {name} does not declare {capability}")
        return made

    def chosen(self, capability: str) -> str:
        """The first name registered that declares the capability and is well; those that come before it and are sick are passed over."""
        for name, (factory, known) in self._made.items():
            if capability in known and self._told(factory) == "ok":
                return name
        raise ValueError(f"ADAPTER_UNAVAILABLE: nothing that is well declares {capability}")

    @staticmethod
    def _told(factory: Callable[[], object]) -> str:
        try:
            made = factory()
            return str(made.health() if hasattr(made, "health") else "ok")
        except Exception as e:  # noqa: BLE001  a sick provider must not hide the others
            return values.redacted_text(f"{type(e).__name__}: {e}")

    def health(self) -> dict[str, str]:
        """``ok``, or why not, of each; one that has no ``health`` is ok once it can be made."""
        return {name: self._told(factory) for name, (factory, _) in sorted(self._made.items())}


class HttpProvider:
    """A provider behind a chat-completion endpoint. The key is read from the environment of the task and never stored or logged."""

    id = "http"

    def __init__(self, endpoint: str, model: str, key_name: str | None = None, timeout: float = 60.0, opener: Callable | None = None):
        self.endpoint, self.model, self.key_name, self.timeout = checked_endpoint(endpoint), model, key_name, timeout
        self.opener = opener

    def translate(self, text: str, options: dict) -> dict:
        import urllib.error
        import urllib.request

        parameters = options.get("model_parameters", {})
        if set(parameters) & values.RESERVED:
            raise translate.ProviderError("CONFIGURATION", "reserved parameters")
        names = {"source_language": options["source_language"], "target_language": options["target_language"], "style": options.get("style", ""), "text": text}
        prompt = re.sub(r"\{(\w+)\}", lambda m: str(names.get(m[1], m[0])), options["prompt_template"])
        body = json.dumps({**parameters, "model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"}
        if self.key_name:
            key = os.environ.get(self.key_name, "").strip()
            if not key:
                raise translate.ProviderError("CONFIGURATION", f"{self.key_name} is not set")
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.endpoint}/chat/completions", body, headers)  # noqa: S310  the scheme was checked
        try:
            with (self.opener or urllib.request.urlopen)(request, timeout=self.timeout) as answer:
                got = json.loads(answer.read())
            content = got["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            code = "RATE_LIMIT" if e.code == 429 else "MODEL_API"
            raise translate.ProviderError(code, f"status {e.code}", e.code == 429 or e.code >= 500) from None
        except TimeoutError:
            raise translate.ProviderError("TIMEOUT", "the endpoint took too long", True) from None
        except urllib.error.URLError as e:
            late = isinstance(e.reason, TimeoutError)
            raise translate.ProviderError("TIMEOUT" if late else "MODEL_API", "the endpoint took too long" if late else "the endpoint could not be reached", True) from None
        except (ValueError, KeyError, IndexError, TypeError):
            raise translate.ProviderError("OUTPUT_MISSING", "the answer has no text", True) from None
        if not isinstance(content, str) or not content.strip():
            raise translate.ProviderError("OUTPUT_MISSING", "the answer has no text", True)
        usage = {k: v for k, v in (got.get("usage") or {}).items() if isinstance(v, int) and not isinstance(v, bool)}
        return {"text": content.strip(), "model": got.get("model", self.model), "usage": usage}
