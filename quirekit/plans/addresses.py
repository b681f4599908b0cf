"""Registered queries over addresses, nested values and raw bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text as fx, values
from ..operators import addressing
from ..sources import sinks
from .texts import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """WITH rows AS (SELECT CASE WHEN conv_id % 3 = 0 THEN conv_id || ':' || turn || ':' || role END AS id, turn, text, 'v' || conv_id AS v FROM conversations WHERE conv_id % 3 < 2),
a AS (SELECT id, max(v) AS v FROM rows WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT turn, text, max(v) AS v FROM rows WHERE id IS NULL GROUP BY 1, 2)
SELECT c.conv_id, c.turn, c.role, coalesce(a.v, b.v) AS value FROM conversations c LEFT JOIN a ON a.id = c.conv_id || ':' || c.turn || ':' || c.role LEFT JOIN b ON b.turn = c.turn AND b.text = c.text"""
)
def segment_by_id_or_place(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("segment_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role"))
    rows = conv.filter("conv_id % 3 < 2").select(F.when(F.col("conv_id") % 3 == 0, F.col("segment_id")).alias("segment_id"), "turn", "text", F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("value"))
    return addressing.by_id_or_place(conv, rows, "value", place=("turn", "text")).select("conv_id", "turn", "role", "value")


@query(
    """SELECT user_id AS doc, event_id AS sequence, CASE WHEN event_type = 'click' THEN 'n' || event_id WHEN event_id % 4 = 2 THEN 'k' || event_id END AS value FROM events"""
)
def translation_addressing(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("key", F.col("event_id").cast("string"))
    one = events.filter("event_type = 'click'").select(F.col("user_id").alias("doc"), F.col("key").alias("address"), F.concat(F.lit("n"), "key").alias("value"))
    two = events.filter("event_id % 2 = 0").select(F.col("user_id").alias("doc"), F.concat(F.lit("loc"), "key").alias("address"), F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("k"), "key")).alias("value"))
    units = events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("sequence"), F.concat(F.lit("loc"), "key").alias("locator_key"))
    return addressing.addressed(units, one.unionByName(two)).select("doc", "sequence", "value")


@query(
    """SELECT event_id, CASE WHEN lower(event_type) IN ('succeeded', 'success', 'ok') AND trim(coalesce(a, b), ' ') <> '' THEN trim(coalesce(a, b), ' ') END AS value
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'failed' ELSE 'Success' END AS event_type, CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN NULL ELSE ' ' || event_type || ' ' END AS a, 'b' || user_id AS b FROM events)"""
)
def normalised_values(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "OK").when(k % 3 == 1, "failed").otherwise("Success")
    first = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", addressing.normalised(status, first, F.concat(F.lit("b"), F.col("user_id").cast("string"))).alias("value"))


@query("SELECT page_id, len(regexp_extract_all(regexp_replace('a{b:url(' || path || ')} /* url(no.png) */ @import \"x' || page_id || '.css\";', '/\\*.*?\\*/', '', 'gs'), '(?i)(?:url\\(\\s*|@import\\s+)[''\"]?([^''\")\\s;]+)', 1)) AS n, path AS first_reference FROM (SELECT page_id, 'p' || page_id || '.png' AS path FROM pages)")
def css_references(spark, sf_dir):
    key = F.col("page_id").cast("string")
    sheet = F.concat(F.lit("a{b:url(p"), key, F.lit('.png)} /* url(no.png) */ @import "x'), key, F.lit('.css";'))
    found = table(spark, sf_dir, "pages").select("page_id", fx.css_references(sheet).alias("r"))
    return found.select("page_id", F.size("r").cast("long").alias("n"), F.col("r")[0].alias("first_reference"))


@query("SELECT page_id, regexp_matches(upper(x), '<!ENTITY|<!DOCTYPE[^>]*\\[') AS refused FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<!DOCTYPE a [<!ELEMENT b ANY>]>' WHEN 1 THEN '<!entity c>' ELSE '' END || html AS x FROM pages)")
def entity_declarations(spark, sf_dir):
    lead = F.when(F.col("page_id") % 3 == 0, "<!DOCTYPE a [<!ELEMENT b ANY>]>").when(F.col("page_id") % 3 == 1, "<!entity c>").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", fx.declares_entities(F.concat(lead, "html")).alias("refused"))


@query("SELECT doc_id, contains(text, 'password') AS found FROM documents WHERE text IS NOT NULL")
def secret_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    body = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    return rows.select("doc_id", values.holds_secret(body, "password").alias("found"))


@query("SELECT doc_id, sha256(regexp_extract(x, '^\\s*')) AS lead, sha256(trim(x, ' ' || chr(10) || chr(9))) AS core, length(x) - length(rtrim(x, ' ' || chr(10) || chr(9))) AS trail FROM (SELECT doc_id, repeat(' ', (doc_id % 4)::BIGINT) || chr(10) || text || chr(9) AS x FROM documents WHERE text IS NOT NULL)")
def outer_space(spark, sf_dir):
    padded = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 4).cast("int")), F.lit("\n"), "text", F.lit("\t"))
    lead, core, trail = fx.outer_space(F.col("x"))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", padded.alias("x"))
    return rows.select("doc_id", ids.sha_text(lead).alias("lead"), ids.sha_text(core).alias("core"), F.length(trail).cast("long").alias("trail"))


@query("SELECT vec_id, '{\"vec_id\":' || vec_id || ',\"label\":' || label || ',\"note\":null}' AS line FROM embeddings")
def json_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sinks.as_json("vec_id", "label", F.lit(None).cast("string").alias("note")).alias("line"))


@query(
    """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
h AS (SELECT sha256(text) AS k, max('r' || doc_id) AS t FROM documents JOIN l USING (doc_id) WHERE quality = 1 AND text IS NOT NULL GROUP BY 1), o AS (SELECT doc_id % 50 AS "order", text, max('o' || doc_id) AS t FROM documents JOIN l USING (doc_id) WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, coalesce(h.t, o.t) AS translated_text, CASE WHEN h.t IS NOT NULL THEN 'other_job' WHEN o.t IS NOT NULL THEN 'same_job' END AS origin, CASE WHEN coalesce(h.t, o.t) IS NULL THEN 'pending' ELSE 'succeeded' END AS status
FROM documents d LEFT JOIN h ON h.k = sha256(d.text) LEFT JOIN o ON o.text = d.text AND o."order" = d.doc_id % 50 WHERE d.text IS NOT NULL"""
)
def replace_segments(spark, sf_dir):
    """All documents as new segments; those of good quality have results of another job, all labelled ones results of their own."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    rows = docs.select("doc_id", ids.sha_text(F.col("text")).alias("input_hash"), (F.col("doc_id") % 50).alias("order"), F.col("text").alias("source_text"))
    labelled = rows.join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    name = lambda c: F.concat(F.lit(c), F.col("doc_id").cast("string"))
    history = labelled.filter("quality = 1").select("input_hash", name("r").alias("reused_text"))
    own = labelled.select("order", "source_text", F.lit("succeeded").alias("status"), name("o").alias("translated_text"))
    return addressing.carried_segments(rows, history, own).select("doc_id", "translated_text", "origin", "status")
