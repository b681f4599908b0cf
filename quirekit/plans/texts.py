"""Registered queries over texts: segmentation, identities, translation, checks and rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text as fx
from ..operators import checks, segment, translate, workspace

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TARGET = "zh-CN"


def units_sql(source: str, key: str, limit: int = 1800) -> str:
    """CTEs that end in units(key, ord, s, e, body, joiner): texts of ``source`` cut paragraph by paragraph. Whitespace is ASCII."""
    window = f"left(rest, {limit})"
    cut = (
        f"CASE WHEN length(rest) <= {limit} THEN length(rest) ELSE coalesce(nullif(length(regexp_extract({window}, '(?s)^(.*[。！？.!?；;])\\s', 1)), 0),"
        f" nullif(length(regexp_extract({window}, '(?s)^(.*\\S)\\s', 1)), 0), {limit}) END"
    )
    return f"""
paras AS (SELECT {key} AS k, text, unnest(range(1, len(p) + 1)) AS b, p, seps FROM (
  SELECT {key}, text, string_split_regex(text, '\\n[ \\t]*\\n+') AS p, regexp_extract_all(text, '\\n[ \\t]*\\n+') AS seps FROM {source} WHERE text IS NOT NULL)),
placed AS (SELECT k, b, p[b] AS para, coalesce(list_sum(list_transform(p[1:b-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(seps[1:b-1], lambda x: length(x))), 0) AS base FROM paras),
trimmed AS (SELECT k, b, regexp_replace(regexp_replace(para, '^\\s+', ''), '\\s+$', '') AS rest, base + length(para) - length(regexp_replace(para, '^\\s+', '')) AS pos FROM placed),
cuts AS (
  SELECT k, b, pos AS s, pos + ({cut}) AS e, rest, pos, {cut} AS n FROM trimmed WHERE length(rest) > 0
  UNION ALL
  SELECT k, b, pos AS s, pos + ({cut}) AS e, rest, pos, {cut} AS n FROM (
    SELECT k, b, regexp_replace(substr(rest, n + 1), '^\\s+', '') AS rest, pos + length(rest) - length(regexp_replace(substr(rest, n + 1), '^\\s+', '')) AS pos FROM cuts WHERE length(rest) > n) WHERE length(rest) > 0),
units AS (SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS ord, s::INT AS s, e::INT AS e, substr(t.text, s::BIGINT + 1, (e - s)::BIGINT) AS body,
  substr(t.text, e::BIGINT + 1, (coalesce(lead(s) OVER (PARTITION BY k ORDER BY s), length(t.text)) - e)::BIGINT) AS joiner, t.text FROM cuts JOIN {source} t ON t.{key} = k)"""


_UNITS = f"WITH RECURSIVE {units_sql('documents', 'doc_id')}"
_ROLE = (
    "CASE WHEN regexp_matches({b}, '^[“‘\"「『—]') THEN 'dialogue' WHEN NOT contains({b}, chr(10)) AND length({b}) <= 100 AND NOT regexp_matches({b}, '[。！？.!?]$') THEN 'heading' ELSE 'paragraph' END"
)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(f"{_UNITS} SELECT doc_id, ord::INT AS \"order\", s AS start, e AS \"end\", length(body)::INT AS chars, sha256(joiner) AS joiner_sha256 FROM units")
def segment_long_documents(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "order", "start", "end", F.length("source_text").alias("chars"), ids.sha_text(F.col("joiner")).alias("joiner_sha256"))


_CONV = "conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"


def conversation_texts(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


@query(f"WITH RECURSIVE {_CONV}, {units_sql('conv', 'conv_id')} SELECT conv_id, ord::INT AS \"order\", s AS start, e AS \"end\", {_ROLE.format(b='body')} AS role, sha256(body) AS source_hash FROM units")
def segment_conversations(spark, sf_dir):
    return segment.segment_texts(conversation_texts(spark, sf_dir), "conv_id").select("conv_id", "order", "start", "end", F.col("content_role").alias("role"), "source_hash")


@query(f"SELECT doc_id, line::INT AS line, {_ROLE.format(b='b')} AS role FROM (SELECT doc_id, unnest(range(len(l))) AS line, trim(l[unnest(range(len(l))) + 1], ' ' || chr(9)) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE b <> ''")
def content_roles(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return lines.filter(fx.strip(F.col("body")) != "").select("doc_id", "line", fx.content_role(F.col("body")).alias("role"))


_ID = "sha256('txt' || chr(0) || 'txt-segmentation.v1' || chr(0) || sha256(text) || chr(0) || s || ':' || e || chr(0) || sha256(body))"


@query(f"{_UNITS} SELECT doc_id, ord::INT AS \"order\", sha256(text) AS source_sha256, sha256(body) AS source_hash, {_ID} AS segment_id FROM units")
def segment_ids(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "order", "source_sha256", "source_hash", "segment_id")


_PROMPT = translate.OPTIONS["prompt_template"].replace("\n", "\\n")


@query(
    f"{_UNITS} SELECT doc_id, ord::INT AS \"order\", sha256('{{\"model_parameters\":{{}},\"prompt_template\":\"{_PROMPT}\",\"prompt_version\":\"v1\",\"segment_id\":\"' || {_ID} || '\",\"source_hash\":\"' || sha256(body) || "
    f"'\",\"source_language\":\"auto\",\"style\":\"\",\"target_language\":\"en\"}}') AS translation_input_hash FROM units"
)
def input_hashes(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "order", "translation_input_hash")


@query(f"SELECT doc_id, sha256('[{TARGET}] ' || text) AS translated_sha256, (length(text) + 8)::INT AS chars FROM documents WHERE text IS NOT NULL AND NOT contains(text, '[[MOCK_FAIL]]')")
def mock_translate(spark, sf_dir):
    out = fx.mock_translation(F.col("text"), F.lit(TARGET))
    return table(spark, sf_dir, "documents").withColumn("out", out).filter("out is not null").select("doc_id", ids.sha_text(F.col("out")).alias("translated_sha256"), F.length("out").alias("chars"))


def _documents_as_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("segment_id"), F.col("text").alias("source_text"), "source")


def _selection(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("segment_id"))


def _existing(spark, sf_dir):
    """Labelled documents have results: toxic ones by hand, of no quality a failure, others from a provider."""
    status = F.when(F.col("toxic") == 1, "manual").when(F.col("quality") == 0, "failed").otherwise("succeeded")
    return table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("segment_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")).select("segment_id", status.alias("status"), F.lit("kept").alias("translated_text"))


@query(
    f"""SELECT d.doc_id AS segment_id, CASE WHEN s.doc_id IS NULL THEN 'source' ELSE 'work' END AS action, CASE WHEN s.doc_id IS NULL THEN 'source' ELSE 'succeeded' END AS status,
 CASE WHEN s.doc_id IS NOT NULL THEN sha256('[{TARGET}] ' || text) END AS translated_sha256, CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END::INT AS attempts
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) s USING (doc_id) WHERE text IS NOT NULL"""
)
def selected_translate(spark, sf_dir):
    """Only the selected documents reach the provider; the others pass through."""
    segments = _documents_as_segments(spark, sf_dir).withColumn("segment_id", F.col("segment_id").cast("string"))
    chosen = _selection(spark, sf_dir).join(segments.select(F.col("segment_id").cast("long").alias("segment_id")), "segment_id", "left_semi").select(F.col("segment_id").cast("string").alias("segment_id"))
    made = translate.translated(segments, selected=chosen, options={"target_language": TARGET}, sleep=False)
    return made.select(F.col("segment_id").cast("long").alias("segment_id"), "action", "status", ids.sha_text(F.col("translated_text")).alias("translated_sha256"), "attempts")


@query("SELECT DISTINCT l_orderkey AS segment_id FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment_id"))
    return translate.unknown_ids(asked, _documents_as_segments(spark, sf_dir))


@query(
    """WITH had AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'manual' WHEN max(quality) = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM labels GROUP BY 1)
SELECT d.doc_id AS segment_id, CASE WHEN h.status IN ('manual', 'succeeded') THEN 'keep' WHEN d.doc_id % 2 = 0 THEN 'work' WHEN h.status IS NOT NULL THEN 'keep' ELSE 'source' END AS action,
 CASE WHEN h.status IN ('manual', 'succeeded') OR (h.status IS NOT NULL AND d.doc_id % 2 <> 0) THEN h.status END AS kept_status
FROM documents d LEFT JOIN had h USING (doc_id) WHERE text IS NOT NULL"""
)
def manual_precedence(spark, sf_dir):
    segments = _documents_as_segments(spark, sf_dir)
    plan = translate.planned(segments, segments.filter("segment_id % 2 = 0").select("segment_id"), _existing(spark, sf_dir))
    return plan.select("segment_id", "action", F.when(F.col("action") == "keep", F.col("kept_status")).alias("kept_status"))


def provider_records(spark, sf_dir):
    """Segments through the real provider harness, some failing."""
    segs = units(spark, sf_dir).withColumn("source_text", F.when(F.col("order") % 7 == 3, F.concat(F.lit(fx.FAIL_MARK), F.col("source_text"))).otherwise(F.col("source_text")))
    return translate.executed(segs, translate.MockProvider, {"target_language": TARGET}, sleep=False).select("segment_id", "status", "attempts", F.col("error.code").alias("error_code"), F.length("translated_text").alias("chars"))


QUERIES["provider_records"] = provider_records
ORACLES["provider_records"] = f"""{_UNITS} SELECT {_ID} AS segment_id, CASE WHEN ord % 7 = 3 THEN 'failed' ELSE 'succeeded' END AS status, (CASE WHEN ord % 7 = 3 THEN 3 ELSE 1 END)::INT AS attempts,
 CASE WHEN ord % 7 = 3 THEN 'PROVIDER_FAILURE' END AS error_code, CASE WHEN ord % 7 <> 3 THEN (length(body) + 8)::INT END AS chars FROM units"""

_STATUS = "CASE WHEN contains(text, 'password') THEN 'failed' WHEN contains(text, 'AKIA') THEN 'cancelled' ELSE 'succeeded' END"


@query(
    f"""SELECT source, CASE WHEN sum((s = 'cancelled')::INT) > 0 THEN CASE WHEN sum((s = 'succeeded')::INT) > 0 THEN 'partially_succeeded' ELSE 'cancelled' END
 WHEN sum((s = 'failed')::INT) = 0 THEN 'succeeded' WHEN sum((s = 'failed')::INT) = count(*) THEN 'failed' ELSE 'partially_succeeded' END AS status, count(*) AS n,
 min(CASE WHEN s = 'failed' THEN doc_id END) AS first_failed FROM (SELECT source, doc_id, {_STATUS} AS s FROM documents) GROUP BY source"""
)
def batch_status_by_source(spark, sf_dir):
    s = F.when(F.contains("text", F.lit("password")), "failed").when(F.contains("text", F.lit("AKIA")), "cancelled").otherwise("succeeded")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", s.alias("status"))
    return rows.groupBy("source").agg(translate.batch_status().alias("status"), F.count("*").alias("n"), F.min(F.when(F.col("status") == "failed", F.col("doc_id"))).alias("first_failed"))


@query(
    """WITH r AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN 'cancelled' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS s FROM events)
SELECT user_id, CASE WHEN sum((s = 'succeeded')::INT) = count(*) THEN 'succeeded' WHEN sum((s = 'succeeded')::INT) > 0 THEN 'partially_succeeded' WHEN sum((s = 'cancelled')::INT) > 0 AND sum((s = 'failed')::INT) = 0 THEN 'cancelled' ELSE 'failed' END AS batch,
 CASE WHEN sum((s = 'succeeded')::INT) = count(*) THEN 'succeeded' WHEN sum((s = 'succeeded')::INT) > 0 THEN 'partially_succeeded' ELSE 'failed' END AS runtime, sum((s = 'succeeded')::INT)::BIGINT AS translated, sum((s <> 'succeeded')::INT)::BIGINT AS omitted FROM r GROUP BY 1"""
)
def manga_status(spark, sf_dir):
    s = F.when(F.col("event_id") % 11 == 0, "cancelled").when(F.col("event_id") % 3 == 0, "failed").otherwise("succeeded")
    rows = table(spark, sf_dir, "events").select("user_id", s.alias("status"))
    good = F.count_if(F.col("status") == "succeeded")
    return rows.groupBy("user_id").agg(translate.page_status().alias("batch"), translate.page_status(runtime=True).alias("runtime"), good.alias("translated"), F.count_if(F.col("status") != "succeeded").alias("omitted"))


@query(
    """WITH r AS (SELECT sha256(text) AS h, doc_id AS job, doc_id AS newest FROM documents WHERE text IS NOT NULL),
w AS (SELECT h, job, row_number() OVER (PARTITION BY h ORDER BY newest DESC) AS k FROM r)
SELECT r.h AS source_hash, r.job AS doc_id, CASE WHEN a.job <> r.job THEN a.job ELSE b.job END AS reused_from FROM r LEFT JOIN w a ON a.h = r.h AND a.k = 1 LEFT JOIN w b ON b.h = r.h AND b.k = 2"""
)
def reuse_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    records = rows.select(F.lit("p").alias("project"), ids.sha_text(F.col("text")).alias("source_hash"), "doc_id", F.col("doc_id").alias("updated_at"), F.lit("succeeded").alias("status"), F.lit("t").alias("translated_text"))
    return checks.reusable(records, "project", "source_hash", "doc_id", "updated_at").select("source_hash", "doc_id", F.col("from_job").alias("reused_from"))


@query(
    """WITH old AS (SELECT turn, text, max('[old] ' || conv_id) AS carried FROM conversations WHERE role = 'user' GROUP BY 1, 2)
SELECT c.conv_id, c.turn, c.role, old.carried FROM conversations c LEFT JOIN old ON old.turn = c.turn AND old.text = c.text"""
)
def reuse_fallback(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    before = conv.filter("role = 'user'").select("turn", "text", F.concat(F.lit("[old] "), F.col("conv_id").cast("string")).alias("translated_text"))
    return checks.carried_over(conv, before, ["turn", "text"]).select("conv_id", "turn", "role", "carried")


def _records(spark, sf_dir):
    """Documents as records: unchanged, shortened, empty or translated, by id."""
    out = F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 5 == 1, F.substring("text", 1, 3)).when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.concat(F.lit("[x] "), "text"))
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select(F.col("doc_id").alias("segment_id"), F.col("text").alias("source_text"), F.lit("succeeded").alias("status"), out.alias("translated_text"))


_RECORDS = """r AS (SELECT doc_id AS segment_id, text AS s, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 3) WHEN 2 THEN NULL ELSE '[x] ' || text END AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT segment_id, unnest(list_filter([CASE WHEN coalesce(t, '') = '' THEN 'missing_translation' END, CASE WHEN coalesce(t, '') <> '' AND trim(t, ' ' || chr(10) || chr(9)) = trim(s, ' ' || chr(10) || chr(9)) THEN 'unchanged_text' END,
 CASE WHEN coalesce(t, '') <> '' AND (length(t) / greatest(length(s), 1) < 0.25 OR length(t) / greatest(length(s), 1) > 4.0) THEN 'length_ratio' END], lambda x: x IS NOT NULL)) AS category, CASE WHEN coalesce(t, '') <> '' THEN length(t) / greatest(length(s), 1) END AS ratio FROM r)"""


@query(f"WITH {_RECORDS} SELECT segment_id, category, CASE WHEN category = 'missing_translation' THEN 'error' ELSE 'warning' END AS severity, round(ratio, 9) AS ratio FROM f")
def qa_findings(spark, sf_dir):
    return checks.findings(_records(spark, sf_dir)).select("segment_id", "category", "severity", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {_RECORDS} SELECT r.segment_id, coalesce(string_agg(category, ',' ORDER BY category), '') AS findings, count(category) AS n_findings FROM r LEFT JOIN f USING (segment_id) GROUP BY 1")
def segments_with_qa(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return checks.with_findings(rows.select("segment_id"), checks.findings(rows)).select("segment_id", "findings", "n_findings")


@query(
    f"{_UNITS} SELECT doc_id, count(*) AS segments, sha256(string_agg('[{TARGET}] ' || body || joiner, '' ORDER BY ord)) AS rebuilt_sha256 FROM units GROUP BY doc_id"
)
def rebuild_sha(spark, sf_dir):
    """Segments, mock translation and rebuild of every document."""
    rows = units(spark, sf_dir).withColumn("status", F.lit("succeeded")).withColumn("out", fx.mock_translation(F.col("source_text"), F.lit(TARGET)))
    rows = rows.withColumn("value", checks.value_of(F.col("status"), F.col("out"), F.col("source_text")))
    texts = checks.rebuilt(rows, "doc_id", "value", F.count("*").alias("segments"))
    return texts.select("doc_id", "segments", ids.sha_text(F.col("text")).alias("rebuilt_sha256"))


@query(
    f"""{_UNITS} SELECT doc_id, sum((ord % 3 <> 0)::INT)::BIGINT AS translated, sum((ord % 3 = 0)::INT)::BIGINT AS preserved,
 sha256(string_agg(CASE ord % 3 WHEN 2 THEN '[x] ' || body ELSE body END || joiner, '' ORDER BY ord)) AS output_sha256 FROM units GROUP BY doc_id"""
)
def translated_preserved_counts(spark, sf_dir):
    """Rebuilds from failed units, units whose result equals the source, and units translated by hand: the last two count as translated."""
    third = F.col("order") % 3
    status = F.when(third == 0, "failed").when(third == 1, "succeeded").otherwise("manual")
    text = F.when(third == 1, F.col("source_text")).when(third == 2, F.concat(F.lit("[x] "), "source_text"))
    records = units(spark, sf_dir).withColumnRenamed("doc_id", "key").withColumn("status", status).withColumn("translated_text", text)
    return workspace.rebuild_documents(records).select(F.col("key").alias("doc_id"), "translated", "preserved", "output_sha256")


_TWICE = f"WITH RECURSIVE {units_sql('(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM documents)', 'doc_id')}"


@query(f"{_TWICE} SELECT doc_id, count(*) AS translated, 0::BIGINT AS preserved, sha256(string_agg('[{TARGET}] ' || body || joiner, '' ORDER BY ord)) AS output_sha256 FROM units GROUP BY doc_id")
def rebuild_copies(spark, sf_dir):
    """Every document twice: equal texts share segment ids, each id is translated once, and every document is rebuilt by itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    records = translate.translated(segment.segment_texts(both.withColumnRenamed("doc_id", "key"), "key"), options={"target_language": TARGET}, sleep=False)
    return workspace.rebuild_documents(records).select(F.col("key").alias("doc_id"), "translated", "preserved", "output_sha256")


@query(
    """WITH p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT conv_id, role, max(n)::INT AS part_count, true AS complete, sha256(string_agg(text || ' ', '' ORDER BY i)) AS text_sha256 FROM p GROUP BY conv_id, role"""
)
def slot_regroup(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role")
    parts = table(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    parts = parts.withColumn("part_index", F.row_number().over(w.orderBy("turn", "text")) - 1).withColumn("part_count", F.count("*").over(w).cast("int")).withColumn("joiner", F.lit(" "))
    return checks.slots(parts, ["conv_id", "role"], "text").select("conv_id", "role", "part_count", "complete", ids.sha_text(F.col("text")).alias("text_sha256"))


_SLOT_CUT = (
    "CASE WHEN length(rest) <= 1800 THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(left(rest, 1800), '(?s)^.{900}.*[.!?。！？；;]')), 0),"
    " nullif(length(regexp_extract(left(rest, 1800), '(?s)^(.{899}.*\\S)\\s', 1)), 0), 1800) END"
)
ORACLES["segment_slots"] = f"""WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS i, rest, {_SLOT_CUT} AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS rest FROM documents) WHERE length(rest) > 0
  UNION ALL
  SELECT doc_id, i, rest, {_SLOT_CUT} AS n FROM (SELECT doc_id, i + 1 AS i, regexp_replace(substr(rest, n + 1), '^\\s+', '') AS rest FROM c WHERE length(rest) > 1800))
SELECT doc_id, i::INT AS part_index, (count(*) OVER (PARTITION BY doc_id))::INT AS part_count, sha256(left(rest, n)) AS source_hash, sha256(regexp_extract(substr(rest, n + 1), '^\\s*')) AS joiner_sha256 FROM c"""


def segment_slots(spark, sf_dir):
    parts = segment.slot_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return parts.select("doc_id", "part_index", "part_count", ids.sha_text(F.col("source_text")).alias("source_hash"), ids.sha_text(F.col("joiner")).alias("joiner_sha256"))


QUERIES["segment_slots"] = segment_slots


@query(
    f"WITH RECURSIVE a AS (WITH RECURSIVE {units_sql('documents', 'doc_id')} SELECT doc_id, ord, s, e FROM units), b AS (WITH RECURSIVE {units_sql('documents', 'doc_id', 900)} SELECT doc_id, ord, s, e FROM units)"
    " SELECT doc_id, ord::INT AS \"order\", CASE WHEN a.s IS NULL THEN 'right' WHEN b.s IS NULL THEN 'left' ELSE 'changed' END AS difference FROM a FULL JOIN b USING (doc_id, ord) WHERE a.s IS DISTINCT FROM b.s OR a.e IS DISTINCT FROM b.e"
)
def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one, two = (segment.unit_places(docs, "doc_id", n) for n in (1800, 900))
    return checks.manifest_difference(one, two, ["doc_id", "order"], ["start", "end"])
