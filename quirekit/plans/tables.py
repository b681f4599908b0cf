"""Registered queries over tables: jobs, steps, archives, scalar functions and references, on analogous driver tables.

Orders stand for jobs (customer: project, status O queued, F succeeded, P running), lineitem for steps, events for artifacts and job events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text as fx
from ..operators import jobs as jb
from ..schemas import JOB_MOVES
from .texts import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'running' END"


def _jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("requested_at"), status.alias("status"))


@query("SELECT o_custkey AS project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS job_id, max(o_orderdate) AS requested_at FROM orders GROUP BY 1")
def latest_job_per_project(spark, sf_dir):
    return jb.latest(_jobs(spark, sf_dir), "project_id", [F.desc("requested_at"), F.desc("job_id")]).select("project_id", "job_id", "requested_at")


@query(f"SELECT o_orderkey AS job_id, {_STATUS} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir).orderBy(F.desc("requested_at"), F.desc("job_id")).limit(10).select("job_id", "status")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def claim_next(spark, sf_dir):
    return jb.claim(_jobs(spark, sf_dir)).select("job_id")


@query(f"SELECT s AS status, count(*) AS jobs, s IN ('queued', 'running', 'paused', 'cancelling') AS active FROM (SELECT {_STATUS} AS s FROM orders) GROUP BY 1")
def active_counts(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("jobs")).withColumn("active", F.col("status").isin("queued", "running", "paused", "cancelling"))


@query(
    "SELECT c_custkey AS project_id, coalesce(n, 0) AS jobs, coalesce(a, 0) AS active, coalesce(a, 0) = 0 AS deletable FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum((o_orderstatus <> 'F')::INT)::BIGINT AS a FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def deletion_impact(spark, sf_dir):
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return jb.deletion_impact(projects, _jobs(spark, sf_dir), "project_id")


_STEPS = """steps AS (SELECT l_orderkey AS job_id, l_linenumber AS position, 1.0 / 8 AS weight, l_discount * 10 AS progress,
 CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'succeeded' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'partially_succeeded' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'running' END AS status FROM lineitem)"""


def _steps(spark, sf_dir):
    done = F.col("l_linestatus") == "F"
    status = F.when(done & (F.col("l_returnflag") == "A"), "succeeded").when(done & (F.col("l_returnflag") == "R"), "partially_succeeded").when(done, "failed").otherwise("running")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("position"), F.lit(0.125).alias("weight"), (F.col("l_discount") * 10).alias("progress"), status.alias("status"))


@query(
    f"""WITH {_STEPS} SELECT job_id, round(least(1.0, sum(CASE WHEN status IN ('succeeded', 'partially_succeeded') THEN weight WHEN status = 'running' THEN weight * least(greatest(progress, 0.0), 1.0) ELSE 0 END))::DOUBLE, 9) AS progress,
 round(sum(CASE WHEN status = 'succeeded' THEN weight ELSE 0 END)::DOUBLE, 9) AS retry_progress, min(CASE WHEN status IN ('failed', 'partially_succeeded', 'cancelled') THEN position END) AS restart_at FROM steps GROUP BY 1"""
)
def weighted_progress(spark, sf_dir):
    out = jb.progress(_steps(spark, sf_dir))
    return out.select("job_id", F.round("progress", 9).alias("progress"), F.round("retry_progress", 9).alias("retry_progress"), "restart_at")


@query(
    f"""WITH {_STEPS}, m AS (SELECT *, min(CASE WHEN status IN ('failed', 'partially_succeeded', 'cancelled') THEN position END) OVER (PARTITION BY job_id) AS b FROM steps)
SELECT job_id, position, CASE WHEN position >= b THEN 'pending' ELSE status END AS status FROM m"""
)
def retry_steps(spark, sf_dir):
    return jb.retried(_steps(spark, sf_dir)).select("job_id", "position", "status")


_FIRST = next(iter(JOB_MOVES))
_EVENT = "CASE event_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'queued' WHEN 4 THEN 'cancelling' WHEN 5 THEN 'failed' ELSE 'running' END"
_ALLOWED = "MAP {" + ", ".join(f"'{a}': [{', '.join(repr(b) for b in bs)}]" if bs else f"'{a}': []::VARCHAR[]" for a, bs in JOB_MOVES.items()) + "}"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, {_EVENT} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS k, '{_FIRST}' AS status, 0 AS refused FROM e UNION ALL
 SELECT e.job_id, e.k, CASE WHEN list_contains(({_ALLOWED})[f.status], e.status) THEN e.status ELSE f.status END, f.refused + CASE WHEN list_contains(({_ALLOWED})[f.status], e.status) THEN 0 ELSE 1 END FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1)
SELECT job_id, status, refused::INT AS refused, status IN ('cancelled', 'succeeded', 'failed', 'partially_succeeded') AS final FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1"""
)
def job_state_fold(spark, sf_dir):
    names = ["running", "paused", "succeeded", "queued", "cancelling", "failed", "running"]
    status = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 7 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return jb.folded(events)


@query("SELECT user_id AS job_id, event_id AS artifact_id, event_type AS kind FROM events QUALIFY user_id = first_value(user_id) OVER (ORDER BY ts DESC, event_id DESC) AND event_type IN ('click', 'view', 'purchase')")
def artifacts_of_latest_job(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select(F.col("user_id").alias("newest"))
    picked = events.join(F.broadcast(newest), F.col("user_id") == F.col("newest"))  # one row
    return picked.filter(F.col("event_type").isin("click", "view", "purchase")).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("artifact_id"), F.col("event_type").alias("kind"))


_IDS = [900, 3, 77, 3, 999_999_999, 12, 500]


@query(f"SELECT pos::INT AS pos, event_id, event_type FROM (SELECT unnest({_IDS}) AS id, unnest(range({len(_IDS)})) AS pos) JOIN events ON event_id = id")
def ordered_artifact_lookup(spark, sf_dir):
    return jb.ordered_lookup(_IDS, table(spark, sf_dir, "events"), "event_id").select("pos", "event_id", "event_type")


@query(
    "WITH n AS (SELECT p_partkey, 'page' || (p_partkey % 120) || '-' || p_size || '.png' AS name, p_brand FROM part) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY regexp_extract(name, 'page([0-9]+)', 1)::INT, regexp_extract(name, '-([0-9]+)', 1)::INT, p_partkey) AS place FROM n"
)
def natural_sort(spark, sf_dir):
    name = F.concat(F.lit("page"), (F.col("p_partkey") % 120).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".png"))
    ranked = table(spark, sf_dir, "part").select("p_brand", "p_partkey", fx.natural_key(name).alias("key"))  # a brand stands for an archive
    return ranked.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_partkey")).cast("long").alias("place"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(x, '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), '(?i)(api[-_]?key|authorization|access[-_]?token|secret|password)(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g')) AS clean_sha256
 FROM (SELECT doc_id, text || ' Authorization: Bearer t' || doc_id || ' x; api_key=k' || doc_id || ', end' AS x FROM documents WHERE text IS NOT NULL)"""
)
def redact_text(spark, sf_dir):
    body = F.concat("text", F.lit(" Authorization: Bearer t"), F.col("doc_id").cast("string"), F.lit(" x; api_key=k"), F.col("doc_id").cast("string"), F.lit(", end"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", ids.sha_text(fx.redact(body)).alias("clean_sha256"))


_TAGS = ["en", "zh-Hans-CN", "English", "e", "en_US", "en-", "en--US", "en-u", "en-u-co-phonebk", "x-private", "de-CH-1901", "sl-rozaj-biske", "en-a-bbb-a-ccc", "en-a-bbb-x-a-ccc", "i-klingon", "art-lojban", ""]
_SINGLES = "regexp_extract_all(regexp_replace(lower(tag) || '-', '-x-.*$', '-'), '-([a-wyz0-9](?:-))', 1)"


@query(
    f"""WITH t AS (SELECT lang AS tag FROM documents WHERE lang IS NOT NULL UNION SELECT unnest({_TAGS!r}))
SELECT tag, length(tag) <= 255 AND regexp_matches(tag, '{fx.BCP47}') AND len(list_distinct({_SINGLES})) = len({_SINGLES}) AS ok FROM t"""
)
def bcp47_check(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("tag")).union(spark.createDataFrame([(t,) for t in _TAGS], "tag string")).distinct()
    return tags.select("tag", fx.language_tag_ok(F.col("tag")).alias("ok"))


_HREF = r"""(?i)\b(?:href|src)\s*=\s*["'']([^"'']*)["'']"""


@query(f"WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS reference FROM pages) SELECT page_id, reference, count(*) AS n FROM r GROUP BY 1, 2")
def reference_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(fx.html_references(F.col("html"))).alias("reference"))
    return rows.groupBy("page_id", "reference").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS reference FROM pages), known AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, reference FROM r WHERE reference NOT IN (SELECT path FROM known WHERE path IS NOT NULL) AND NOT starts_with(reference, '#')"""
)
def missing_references(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(fx.html_references(F.col("html"))).alias("reference")).distinct()
    known = pages.select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("reference")).distinct()
    return found.join(known, "reference", "left_anti").filter(~F.col("reference").startswith("#")).select("page_id", "reference")


_BASE = "string_split(url, '/')[-1]"


@query(
    f"""SELECT page_id, CASE WHEN n = '' THEN 'artifact.bin' ELSE n END AS safe, regexp_replace(b, '[^A-Za-z0-9._-]+', '-', 'g') AS slug, m AS media_type FROM (SELECT page_id, {_BASE} AS b,
 left(regexp_replace(regexp_replace(regexp_replace({_BASE}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), '[._]+$', ''), 180) AS n,
 CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' END AS m FROM pages WHERE url IS NOT NULL)"""
)
def safe_filename(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", fx.safe_filename(u).alias("safe"), fx.slug(F.element_at(F.split(u, "/"), -1)).alias("slug"), fx.media_type(u).alias("media_type"))


@query(
    """WITH m AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '../' || split_part(url, '://', 2) WHEN 1 THEN 'a//' || page_id WHEN 2 THEN 'c:/' || page_id WHEN 3 THEN 'a/./b' WHEN 4 THEN repeat('d/', 21) || 'x' ELSE 'ok/' || page_id || '.xhtml' END AS name FROM pages)
SELECT page_id, CASE WHEN list_has_any(string_split(regexp_replace(name, '/$', ''), '/'), ['', '.', '..']) THEN 'path' WHEN contains(string_split(name, '/')[1], ':') THEN 'path' WHEN len(string_split(regexp_replace(name, '/$', ''), '/')) > 20 THEN 'depth' END AS refused FROM m"""
)
def member_path_safety(spark, sf_dir):
    k = F.col("page_id") % 6
    key = F.col("page_id").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("../"), F.element_at(F.split("url", "://"), 2))).when(k == 1, F.concat(F.lit("a//"), key)).when(k == 2, F.concat(F.lit("c:/"), key)).when(k == 3, F.lit("a/./b"))
        .when(k == 4, F.lit("d/" * 21 + "x")).otherwise(F.concat(F.lit("ok/"), key, F.lit(".xhtml")))
    )
    return table(spark, sf_dir, "pages").select("page_id", fx.unsafe_member(name).alias("refused"))


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) WHEN 2 THEN replace(text, chr(10), ' ') WHEN 3 THEN text || chr(13) ELSE text END AS x FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, x, contains(x, chr(13) || chr(10))::INT AS a, contains(replace(x, chr(13) || chr(10), ''), chr(13))::INT AS b, contains(replace(x, chr(13) || chr(10), ''), chr(10))::INT AS d FROM t)
SELECT doc_id, CASE WHEN a + b + d > 1 THEN 'mixed' WHEN a = 1 THEN 'crlf' WHEN b = 1 THEN 'cr' WHEN d = 1 THEN 'lf' ELSE 'none' END AS newline, sha256(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS plain_sha256 FROM c"""
)
def newline_styles(spark, sf_dir):
    k, t = F.col("doc_id") % 5, F.col("text")
    swap = lambda to: F.replace(t, F.lit("\n"), F.lit(to))
    x = F.when(k == 0, swap("\r\n")).when(k == 1, swap("\r")).when(k == 2, swap(" ")).when(k == 3, F.concat(t, F.lit("\r"))).otherwise(t)
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", x.alias("x"))
    return rows.select("doc_id", fx.newline_style(F.col("x")).alias("newline"), ids.sha_text(fx.plain_newlines(F.col("x"))).alias("plain_sha256"))


@query(
    """SELECT l_orderkey, l_linenumber, least(0.25 * pow(2, l_linenumber - 1), 10.0) AS backoff, least(greatest(l_discount * 20 - 0.5, 0.0), 1.0) AS clamped,
 CASE WHEN l_quantity::INT % 10 = 0 THEN 0.0 WHEN l_linenumber = 7 THEN 'infinity'::DOUBLE ELSE (l_quantity::INT % 10) / l_linenumber END AS ratio, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM lineitem"""
)
def scalar_policies(spark, sf_dir):
    n, size = F.col("l_linenumber"), F.bround("l_quantity").cast("int") % 10  # the SQL's cast rounds halves to even
    odd = F.when(n < 0, size / n).otherwise(F.signum(size) * float("inf"))  # of line numbers below one
    ratio = F.when((n <= 0) & ~size.eqNullSafe(0), odd).otherwise(fx.compression_ratio(size, F.when(n == 7, 0).otherwise(n)))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.backoff_seconds(F.lit(0.25), F.col("l_linenumber")).alias("backoff"), fx.clamp(F.col("l_discount") * 20 - 0.5).alias("clamped"), ratio.alias("ratio"), fx.iso_utc(F.col("l_shipdate")).alias("iso")
    )


@query("SELECT DISTINCT lang, CASE lower(lang) WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRA' WHEN 'de' THEN 'DEU' WHEN 'es' THEN 'ESP' ELSE upper(lang) END AS code FROM documents WHERE lang IS NOT NULL")
def adapter_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang is not null").select("lang", fx.adapter_language(F.col("lang")).alias("code")).distinct()


@query(
    """SELECT doc_id, sha256('Translate from ' || lang || ' to zh-CN. Style: plain. Return only the translation.' || chr(10) || chr(10) || text) AS prompt_sha256, to_base64(encode(left(text, 12))) AS head64 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"""
)
def prompts(spark, sf_dir):
    from ..operators.translate import OPTIONS

    body = fx.prompt(OPTIONS["prompt_template"], F.col("lang"), F.lit("zh-CN"), F.lit("plain"), F.col("text"))
    rows = table(spark, sf_dir, "documents").filter("text is not null and lang is not null")
    return rows.select("doc_id", ids.sha_text(body).alias("prompt_sha256"), F.base64(F.encode(F.substring("text", 1, 12), "UTF-8")).alias("head64"))


@query("SELECT source, count(DISTINCT sha256(text)) AS distinct_texts, count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text))::INT AS longest FROM documents GROUP BY source")
def source_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.countDistinct(ids.sha_text(F.col("text"))).alias("distinct_texts"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query(
    """WITH u AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), d AS (SELECT conv_id, count(*) AS units FROM u GROUP BY 1)
SELECT conv_id % 10 AS package, conv_id, dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) - 1 AS document_order, units, coalesce(sum(units) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_unit_start FROM d"""
)
def document_offsets(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("units"))
    per = per.withColumn("package", F.col("conv_id") % 10)
    w = Window.partitionBy("package").orderBy("conv_id")
    start = F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("package", "conv_id", (F.dense_rank().over(w) - 1).cast("long").alias("document_order"), "units", start.alias("text_unit_start"))


@query("SELECT lower(event_type) AS portable, user_id, count(*) AS copies, min(event_id) AS first_id FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_members(spark, sf_dir):
    w = Window.partitionBy("user_id", "portable")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.lower("event_type").alias("portable"))
    marked = rows.withColumn("copies", F.count("*").over(w)).filter("copies > 1")
    return marked.groupBy("portable", "user_id").agg(F.max("copies").alias("copies"), F.min("event_id").alias("first_id"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM f GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """Kinds of events by user, once each, in the order of their first occurrence."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))
