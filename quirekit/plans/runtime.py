"""Registered queries of the runtime's operators, on analogous driver tables: orders stand for jobs, lineitem for their pages and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runtime as rt
from .texts import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """SELECT c_custkey AS project_id, coalesce(n, 0) AS n_jobs, coalesce(jobs, '') AS jobs FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS jobs FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def nested_loads(spark, sf_dir):
    """Projects with their jobs nested, in the order of their dates."""
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    out = rt.nested(projects, "project_id", jobs=(made, ["job_id", "status"], ["o_orderdate", "job_id"]))
    names = F.transform("jobs", lambda j: F.concat(j["job_id"].cast("string"), F.lit(":"), j["status"]))
    return out.select("project_id", F.size("jobs").cast("long").alias("n_jobs"), F.array_join(names, ",").alias("jobs"))


def _pages(spark, sf_dir):
    """Events as pages of their user's project; two neighbours may share a source artifact."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("page_id"), F.col("event_id").alias("order"), F.floor(F.col("event_id") / 2).alias("source"), "event_type", "ts")


@query(
    """WITH e AS (SELECT user_id, event_id // 2 AS source, max_by(event_id, (ts, event_id)) AS made FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT v.user_id AS project_id, event_id AS page_id, CASE WHEN event_type <> 'view' THEN made END AS reused_artifact_id,
 CASE WHEN event_type = 'view' THEN 'missing' WHEN made IS NOT NULL THEN 'reuse' ELSE 'translate' END AS action FROM events v LEFT JOIN e ON e.user_id = v.user_id AND e.source = event_id // 2"""
)
def page_reuse(spark, sf_dir):
    """Pages with a source artifact (no views) reuse the newest thing an earlier job (purchases) made of the same artifact."""
    pages = _pages(spark, sf_dir)
    artifacts = pages.filter("event_type <> 'view'").select("project_id", "page_id", F.col("source").alias("artifact_id"))
    earlier = pages.filter("event_type = 'purchase'").select("project_id", F.col("source").alias("source_artifact_id"), F.col("page_id").alias("artifact_id"), F.col("ts").alias("created_at"))
    return rt.reused_pages(pages.select("project_id", "page_id", "order"), artifacts, earlier).select("project_id", "page_id", "reused_artifact_id", "action")


@query("""SELECT user_id AS project_id, event_id AS "order", CASE WHEN event_type <> 'view' THEN event_id // 2 END AS artifact_id, event_type = 'view' AS omitted FROM events""")
def export_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    made = pages.filter("event_type <> 'view'").select("project_id", "page_id", F.col("source").alias("artifact_id"))
    return rt.exported_pages(pages.select("project_id", "page_id", "order"), made).select("project_id", "order", "artifact_id", "omitted")


_PIPELINES = (
    ("detect_encoding", "extract_text", "segment_text", "translate_text", "quality_check", "export_novel", "unknown"),
    ("inspect_epub", "segment_epub", "translate_text", "quality_check", "export_epub", "unknown", "unknown"),
    ("prepare_manga", "translate_manga", "export_manga", "unknown", "unknown", "unknown", "unknown"),
)


#: Line numbers of an order repeat here and there: places are counted; those after the seventh are no steps.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


@query(
    f"""WITH r AS (SELECT l_orderkey AS job_id, {_PLACE} AS run, CASE l_suppkey WHEN 1 THEN NULL ELSE CASE WHEN l_returnflag = 'N' THEN [] ELSE [l_partkey, l_suppkey] END END AS outputs, o_custkey AS file,
 CASE l_orderkey % 3 WHEN 0 THEN ['detect_encoding', 'extract_text', 'segment_text', 'translate_text', 'quality_check', 'export_novel', 'unknown'][run::INT]
  WHEN 1 THEN ['inspect_epub', 'segment_epub', 'translate_text', 'quality_check', 'export_epub', 'unknown', 'unknown'][run::INT]
  ELSE ['prepare_manga', 'translate_manga', 'export_manga', 'unknown', 'unknown', 'unknown', 'unknown'][run::INT] END AS step FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
o AS (SELECT job_id, any_value(outputs) FILTER (step = 'detect_encoding') AS enc, any_value(outputs) FILTER (step = 'extract_text') AS txt, any_value(outputs) FILTER (step = 'inspect_epub') AS epub,
 any_value(outputs) FILTER (step IN ('segment_text', 'segment_epub')) AS seg, any_value(outputs) FILTER (step = 'translate_text') AS tr, any_value(outputs) FILTER (step = 'quality_check') AS qa,
 any_value(outputs) FILTER (step = 'prepare_manga') AS prep, any_value(outputs) FILTER (step = 'translate_manga') AS pages FROM r GROUP BY 1)
SELECT job_id, run, step, coalesce(array_to_string(CASE WHEN step IN ('detect_encoding', 'inspect_epub', 'prepare_manga') THEN [file] WHEN step = 'extract_text' THEN [file] || coalesce(enc, [])
 WHEN step = 'segment_text' THEN txt WHEN step = 'segment_epub' THEN epub WHEN step = 'translate_text' THEN seg WHEN step = 'quality_check' THEN tr WHEN step = 'export_novel' THEN coalesce(tr, []) || coalesce(qa, [])
 WHEN step = 'export_epub' THEN coalesce(epub, []) || coalesce(tr, []) || coalesce(qa, []) WHEN step = 'translate_manga' THEN prep WHEN step = 'export_manga' THEN pages END, ','), '') AS inputs FROM r JOIN o USING (job_id)"""
)
def step_inputs(spark, sf_dir):
    """The artifacts each step of a job reads: orders are jobs of three pipelines, lineitems their steps with two artifacts, or none, put out."""
    rows = table(spark, sf_dir, "lineitem").withColumn("run", F.expr(_PLACE).cast("long"))
    place = (F.col("run") - 1).cast("int")
    kind = F.col("l_orderkey") % 3
    step = F.when(kind == 0, F.get(F.array(*map(F.lit, _PIPELINES[0])), place)).when(kind == 1, F.get(F.array(*map(F.lit, _PIPELINES[1])), place)).otherwise(F.get(F.array(*map(F.lit, _PIPELINES[2])), place))
    outputs = F.when(F.col("l_suppkey") != 1, F.when(F.col("l_returnflag") == "N", F.array().cast("array<bigint>")).otherwise(F.array("l_partkey", "l_suppkey")))
    runs = rows.select(F.col("l_orderkey").alias("job_id"), "run", step.alias("step"), outputs.alias("outputs"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("source_artifact"))
    return rt.step_inputs(runs, sources).select("job_id", "run", "step", F.array_join("inputs", ",").alias("inputs"))


@query(
    """SELECT l_orderkey AS job_id, coalesce(bool_or(CASE WHEN l_returnflag = 'N' THEN l_linestatus = 'O' END), false) AS retryable, bool_and(l_returnflag <> 'N') AS whole FROM lineitem GROUP BY 1"""
)
def retryable_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "failed").otherwise("succeeded")
    error = F.when(F.col("l_returnflag") == "N", F.struct((F.col("l_linestatus") == "O").alias("retryable")))
    return rt.retryable_batches(rows.select(F.col("l_orderkey").alias("job_id"), status.alias("status"), error.alias("error")), "job_id")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'messages' WHEN 1 THEN 'model' ELSE '' END AS reserved FROM events")
def reserved_parameters(spark, sf_dir):
    """Names of a request's own fields among a model's parameters."""
    name = F.when(F.col("event_id") % 3 == 0, "messages").when(F.col("event_id") % 3 == 1, "model").otherwise("top_p")
    found = rt.reserved_parameters(F.create_map(name, F.col("value"), F.lit("temperature"), F.lit(0.0)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("reserved"))


@query(
    """SELECT doc_id, '{"project":{"id":' || doc_id || ',"source":' || coalesce('"' || source || '"', 'null') || '},"profile":null,"manifest":{"chars":' || length(text) || '},"segments":[{"order":0,"text_sha256":"' || sha256(text) || '"}],"build":null}' AS body FROM documents WHERE text IS NOT NULL"""
)
def export_json(spark, sf_dir):
    none = F.lit(None).cast("string")
    segments = F.array(F.struct(F.lit(0).alias("order"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    body = rt.export_json(F.struct(F.col("doc_id").alias("id"), "source"), none, F.struct(F.length("text").alias("chars")), segments, none)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", body.alias("body"))


@query("SELECT event_id, 3 AS schema_version, event_type AS kind, CASE WHEN event_id % 3 = 2 THEN value ELSE 0 END AS weight FROM events")
def migrate_rows(spark, sf_dir):
    """Rows of three versions brought to the newest: the first step renames a column, the second adds one."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3 + 1).cast("int").alias("schema_version"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("name"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 2, F.col("value")).alias("weight"))
    steps = {1: lambda df: df.withColumn("kind", F.col("name")), 2: lambda df: df.withColumn("weight", F.lit(0.0))}
    return rt.migrated(rows, steps).select("event_id", "schema_version", "kind", "weight")
