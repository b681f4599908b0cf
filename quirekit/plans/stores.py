"""Registered queries of stores, commits, progress, addresses and the runner, on analogous driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import addressing, attempts, commits, deletion, doctor, prefix
from ..sources import records
from ..streaming import runner
from .texts import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """WITH c AS (SELECT user_id AS k, event_id::VARCHAR AS s, epoch(ts) AS told, 'retry' AS kind, 1 AS attempt, false AS ends FROM events WHERE event_type = 'purchase'
 UNION ALL SELECT user_id, event_id::VARCHAR, epoch(ts), CASE WHEN event_type IN ('purchase', 'click') THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' ELSE 'cancelled' END, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, true FROM events),
n AS (SELECT *, count_if(ends) OVER w AS ended, row_number() OVER w AS place, count_if(ends) OVER (PARTITION BY k) AS total FROM c WINDOW w AS (PARTITION BY k ORDER BY told, s, attempt ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, max(total) AS total, CASE WHEN count_if(kind = 'succeeded') = max(total) THEN 'succeeded' WHEN count_if(kind = 'succeeded') > 0 THEN 'partially_succeeded' WHEN count_if(kind = 'cancelled') > 0 THEN 'cancelled' ELSE 'failed' END AS status FROM n GROUP BY 1)
SELECT k AS user_id, place * 2 AS seq, kind, (ended - ends::INT)::BIGINT AS completed, total::BIGINT AS total, s AS segment_id, attempt, NULL AS message FROM n
UNION ALL SELECT k, place * 2 + 1, 'progress', ended::BIGINT, total::BIGINT, s, NULL, NULL FROM n WHERE ends
UNION ALL SELECT k, 0, 'started', 0, total::BIGINT, NULL, NULL, 'translation' FROM t UNION ALL SELECT k, 4611686018427387903, 'completed', total::BIGINT, total::BIGINT, NULL, NULL, status FROM t"""
)
def progress_events(spark, sf_dir):
    """Users as batches, their events as calls: purchases succeed at the second attempt, clicks at the first, errors fail, others are cancelled."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    end = F.when(F.col("event_type").isin("purchase", "click"), "succeeded").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    event = lambda kind, attempt: F.struct(kind.alias("kind"), F.lit(attempt).alias("attempt"), at.alias("at"), F.lit(None).cast("string").alias("code"))
    told = F.when(F.col("event_type") == "purchase", F.array(event(F.lit("retry"), 1), event(end, 2))).otherwise(F.array(event(end, 1)))
    records = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("segment_id"), end.alias("status"), told.alias("events"))
    return attempts.progress_events(records, "user_id").drop("event_id")


@query(
    """WITH f AS (SELECT 'p' || p_partkey AS storage_key, p_size::BIGINT AS size, DATE '2024-01-01' + (p_size::INT) AS modified, p_partkey % 7 = 0 AS pending FROM part
 UNION ALL SELECT 's' || s_suppkey, 1, DATE '2024-01-01' + (s_suppkey % 50)::INT, false FROM supplier),
a AS (SELECT 'p' || l_partkey AS storage_key, o_orderstatus = 'F' AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
live AS (SELECT DISTINCT storage_key FROM a WHERE NOT gone), had AS (SELECT DISTINCT storage_key FROM a WHERE gone)
SELECT storage_key, size, reason FROM (SELECT storage_key, size, CASE WHEN storage_key IN (FROM had) THEN 'deleted' WHEN modified < DATE '2024-02-01' - 1 THEN CASE WHEN pending THEN 'pending' ELSE 'orphan' END END AS reason
 FROM f WHERE storage_key NOT IN (FROM live)) WHERE reason IS NOT NULL"""
)
def sweep_marks(spark, sf_dir):
    """Parts and suppliers as files, lineitems as artifacts; projects with finished orders were deleted."""
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    files = parts.select(F.concat(F.lit("p"), "p_partkey").alias("storage_key"), F.col("p_size").cast("long").alias("size"), day(F.col("p_size")).alias("modified"), (F.col("p_partkey") % 7 == 0).alias("pending"))
    files = files.unionByName(suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("storage_key"), F.lit(1).cast("long").alias("size"), day(F.col("s_suppkey") % 50).alias("modified"), F.lit(False).alias("pending")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    artifacts = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(F.concat(F.lit("p"), "l_partkey").alias("storage_key"), "o_orderstatus")
    now = F.lit("2024-02-01").cast("timestamp")
    return deletion.garbage(files, artifacts.filter("o_orderstatus <> 'F'"), artifacts.filter("o_orderstatus = 'F'"), now, timedelta(days=1))


@query("SELECT o_custkey AS job_id, max(o_orderkey)::VARCHAR AS write, max(o_orderkey) AS version FROM orders GROUP BY 1")
def last_writes(spark, sf_dir):
    """Orders as commits of their customer's rows: the last of each."""
    named = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").cast("string").alias("write"), F.col("o_orderkey").alias("version"))
    return commits.last_writes(named, "job_id")


#: Line numbers of an order repeat here and there: places are counted.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_LINES = f"SELECT l_orderkey AS doc, {_PLACE} - 1 AS sequence, 'k' || l_partkey AS locator_key, 't' || l_suppkey AS locator_tuple, * FROM lineitem"


@query(
    f"""WITH l AS (SELECT l_orderkey AS job_id, {_PLACE} AS n, l_returnflag AS f FROM lineitem QUALIFY n <= 3),
s AS (SELECT o_orderkey AS job_id, count(n) AS steps, min(n) FILTER (f = 'N') AS failed, count_if(f = 'R') AS part FROM orders LEFT JOIN l ON job_id = o_orderkey GROUP BY 1)
SELECT job_id::VARCHAR AS job_id, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN steps < 3 THEN 'running' WHEN part > 0 THEN 'partially_succeeded' ELSE 'succeeded' END AS status,
 least(coalesce(failed, 99), steps + 1, 3)::BIGINT AS orders, CASE WHEN failed IS NOT NULL THEN steps - failed ELSE 0 END::BIGINT AS refused FROM s"""
)
def job_runs(spark, sf_dir):
    """The runner's processor over a table: orders submit jobs of three steps, their first lineitems are the steps' results."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumn("n", F.expr(_PLACE)).filter("n <= 3")
    steps = F.array(F.lit("prepare_manga"), F.lit("translate_manga"), F.lit("export_manga"))
    none = lambda kind: F.lit(None).cast(kind)
    sent = orders.select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit(runner.SUBMIT).alias("kind"), F.lit("manga_full_v1").alias("word"), none("string").alias("step"), none("int").alias("try"), none("array<string>").alias("outputs"), none("string").alias("code"), F.timestamp_seconds(F.lit(0)).alias("at"))
    word = F.when(F.col("l_returnflag") == "N", "failed").when(F.col("l_returnflag") == "R", "partially_succeeded").otherwise("succeeded")
    n = F.col("n").cast("int")
    results = lines.select(F.col("l_orderkey").cast("string").alias("job_id"), F.lit(runner.RESULT).alias("kind"), word.alias("word"), F.element_at(steps, n).alias("step"), n.alias("try"), none("array<string>").alias("outputs"), none("string").alias("code"), F.timestamp_seconds(n).alias("at"))
    told = runner.answers(sent.unionByName(results))
    status = F.max_by("status", F.when((F.col("kind") == runner.EVENT) & F.col("step").isNull(), F.col("seq")))
    return told.groupBy("job_id").agg(status.alias("status"), F.count_if(F.col("kind") == runner.ORDER).alias("orders"), F.count_if(F.col("kind") == runner.REFUSED).alias("refused"))


@query(
    f"""WITH u AS ({_LINES}), n AS (SELECT doc, sequence, CASE WHEN l_quantity >= 10 THEN 'n' || l_partkey END AS v FROM u WHERE l_returnflag = 'A'),
s AS (SELECT doc, sequence, CASE WHEN l_quantity >= 20 THEN 's' || l_partkey END AS v FROM u WHERE l_returnflag = 'R'), k AS (SELECT doc, locator_key, max('k' || l_linenumber) AS v FROM u WHERE l_quantity > 25 GROUP BY 1, 2),
t AS (SELECT doc, locator_tuple, max('t' || l_linenumber) AS v FROM u WHERE l_quantity > 5 GROUP BY 1, 2)
SELECT u.doc, u.sequence, CASE WHEN n.doc IS NOT NULL THEN n.v WHEN s.doc IS NOT NULL THEN s.v WHEN k.doc IS NOT NULL THEN k.v ELSE t.v END AS value FROM u LEFT JOIN n USING (doc, sequence) LEFT JOIN s USING (doc, sequence)
LEFT JOIN k ON k.doc = u.doc AND k.locator_key = u.locator_key LEFT JOIN t ON t.doc = u.doc AND t.locator_tuple = u.locator_tuple"""
)
def address_kinds(spark, sf_dir):
    """Lineitems as units of their order; entries of all kinds of addresses, some with a null value that decides all the same."""
    rows = _lines(spark, sf_dir)
    number, text = F.col("sequence").cast("string"), lambda letter, name: F.concat(F.lit(letter), F.col(name))
    entry = lambda kept, kind, address, value: F.when(F.expr(kept), F.struct(F.lit(kind).alias("kind"), address.alias("address"), value.alias("value")))
    told = [
        entry("l_returnflag = 'A'", addressing.NUMBER, number, F.when(F.col("l_quantity") >= 10, text("n", "l_partkey"))),
        entry("l_returnflag = 'R'", addressing.TEXT, number, F.when(F.col("l_quantity") >= 20, text("s", "l_partkey"))),
        entry("l_quantity > 25", addressing.TEXT, F.col("locator_key"), text("k", "l_linenumber")),
        entry("l_quantity > 5", addressing.TUPLE, F.col("locator_tuple"), text("t", "l_linenumber")),
    ]
    entries = rows.select("doc", F.explode(F.array_compact(F.array(*told))).alias("entry")).select("doc", "entry.*")  # all kinds from one reading
    return addressing.addressed(rows.select("doc", "sequence", "locator_key", "locator_tuple"), entries).select("doc", "sequence", "value")


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc"), (F.expr(_PLACE) - 1).alias("sequence"), F.concat(F.lit("k"), "l_partkey").alias("locator_key"), F.concat(F.lit("t"), "l_suppkey").alias("locator_tuple"), *rows.columns)


@query(
    f"""WITH u AS ({_LINES}), r AS (SELECT doc, sequence AS position, CASE l_returnflag WHEN 'A' THEN (l_linenumber % 5 - 1)::VARCHAR WHEN 'N' THEN CASE WHEN l_quantity > 40 THEN 'x' ELSE ' +0' || (l_linenumber % 3) || ' ' END END AS named,
 CASE WHEN l_quantity > 10 THEN 'k' || (l_partkey + (l_quantity > 30)::INT) END AS locator_key, CASE WHEN l_quantity > 3 THEN 'v' || l_linenumber END AS v FROM u),
p AS (SELECT doc, locator_key, max(sequence) AS placed FROM u GROUP BY 1, 2),
g AS (SELECT r.doc, CASE WHEN named IS NOT NULL THEN try_cast(replace(trim(named), '+', '') AS BIGINT) ELSE coalesce(placed, position) END AS sequence, position, v FROM r LEFT JOIN p ON p.doc = r.doc AND p.locator_key = r.locator_key WHERE v IS NOT NULL),
b AS (SELECT doc, sequence, arg_max(v, position) AS value FROM g GROUP BY 1, 2)
SELECT u.doc, u.sequence, value FROM u LEFT JOIN b USING (doc, sequence)"""
)
def address_list(spark, sf_dir):
    """A list's records by the sequence they name, their locator, or their position; the last one counts."""
    rows = _lines(spark, sf_dir)
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    named = F.when(F.col("l_returnflag") == "A", (n % 5 - 1).cast("string")).when(F.col("l_returnflag") == "N", F.when(q > 40, "x").otherwise(F.concat(F.lit(" +0"), n % 3, F.lit(" "))))
    locator = F.when(q > 10, F.concat(F.lit("k"), F.col("l_partkey") + (q > 30).cast("int")))
    records = rows.select("doc", F.col("sequence").alias("position"), named.alias("sequence"), locator.alias("locator_key"), F.when(q > 3, F.concat(F.lit("v"), n)).alias("value"))
    return addressing.addressed_list(rows.select("doc", "sequence", "locator_key"), records).select("doc", "sequence", "value")


_CENTS = "round(l_extendedprice * 100)"
_IN_FLAG = "OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, place ROWS UNBOUNDED PRECEDING)"


def _placed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("place", F.expr(_PLACE).cast("long"))
    return rows.select("l_returnflag", "l_orderkey", "place", F.expr(_CENTS).cast("long").alias("size"))


@query(f"SELECT l_returnflag, l_orderkey, place, size, (sum(size) {_IN_FLAG})::BIGINT AS running FROM (SELECT *, {_PLACE} AS place, {_CENTS}::BIGINT AS size FROM lineitem)")
def running_sizes(spark, sf_dir):
    """Lineitems as members of three huge archives, one a return flag: the bytes read up to each."""
    return prefix.running_sums(_placed(spark, sf_dir), ["l_returnflag"], ["l_orderkey", "place"], F.col("size"))


@query(
    f"""SELECT l_returnflag, l_orderkey, place, running FROM (SELECT l_returnflag, l_orderkey, place, (sum(size) {_IN_FLAG})::BIGINT AS running FROM (SELECT *, {_PLACE} AS place, {_CENTS}::BIGINT AS size FROM lineitem))
WHERE running > 1000000000 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, place) = 1"""
)
def size_limits(spark, sf_dir):
    """The member at which each of those archives passes ten million units."""
    return prefix.over_limit(_placed(spark, sf_dir), ["l_returnflag"], ["l_orderkey", "place"], F.col("size"), 1_000_000_000).select("l_returnflag", "l_orderkey", "place", "running")


@query("SELECT event_type, user_id, first, (row_number() OVER (PARTITION BY event_type ORDER BY first) - 1)::BIGINT AS place FROM (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY 1, 2)")
def first_occurrences(spark, sf_dir):
    """Users in the order in which they first appear among the events of a type: a spine's documents, once each."""
    return prefix.first_occurrences(table(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id")


@query("SELECT doc_id, source, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def unit_starts(spark, sf_dir):
    """Where each document's characters begin in its source, read one after the other."""
    return prefix.starts(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], F.length("text").cast("long")).select("doc_id", "source", "start")


@query(
    """WITH n AS (SELECT 'project' AS kind, o_custkey::VARCHAR AS key, 'PROJECT_MISSING' AS code FROM orders UNION ALL SELECT 'project', user_id::VARCHAR, 'PROJECT_MISSING' FROM events UNION ALL SELECT 'project', s_nationkey::VARCHAR, 'PROJECT_MISSING' FROM supplier
 UNION ALL SELECT 'artifact', s_suppkey::VARCHAR, 'ARTIFACT_MISSING' FROM supplier UNION ALL SELECT 'job', l_orderkey::VARCHAR, 'JOB_MISSING' FROM lineitem),
h AS (SELECT 'project' AS kind, c_custkey::VARCHAR AS key FROM customer UNION SELECT 'job', o_orderkey::VARCHAR FROM orders UNION SELECT 'artifact', event_id::VARCHAR FROM events),
a AS (SELECT 'f' || (event_id % 300) AS key, event_id % 3 AS size FROM events), b AS (SELECT key, count(*) AS n, min(size) AS low, max(size) AS high FROM a GROUP BY 1), f AS (SELECT 'f' || p_partkey AS key, p_partkey % 3 AS size FROM part)
SELECT kind, key, max(code) AS code, count(*) AS "references" FROM n ANTI JOIN h USING (kind, key) GROUP BY 1, 2
UNION ALL SELECT 'payload', key, CASE WHEN f.key IS NULL THEN 'PAYLOAD_MISSING' WHEN b.key IS NULL THEN 'PAYLOAD_ORPHAN' ELSE 'PAYLOAD_ALTERED' END, coalesce(n, 0) FROM b FULL JOIN f USING (key) WHERE f.key IS NULL OR b.key IS NULL OR low <> size OR high <> size"""
)
def reconciliation(spark, sf_dir):
    """Customers as projects, orders as jobs, events as artifacts, suppliers as sources, lineitems as segments, parts as files."""
    rows = {name: table(spark, sf_dir, name) for name in ("customer", "orders", "events", "supplier", "lineitem", "part")}
    tables = {
        "projects": rows["customer"].select(F.col("c_custkey").alias("project_id")),
        "jobs": rows["orders"].select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id")),
        "artifacts": rows["events"].select(F.col("event_id").alias("artifact_id"), F.col("user_id").alias("project_id"), F.concat(F.lit("f"), F.col("event_id") % 300).alias("storage_key"), (F.col("event_id") % 3).alias("size")),
        "sources": rows["supplier"].select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("artifact_id")),
        "segments": rows["lineitem"].select(F.col("l_orderkey").alias("job_id")),
    }
    files = rows["part"].select(F.concat(F.lit("f"), "p_partkey").alias("storage_key"), (F.col("p_partkey") % 3).alias("size"))
    return doctor.reconciled(tables, files)


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN event_type = 'click' THEN 'pdf' ELSE 'txt' END END AS source_format, CASE WHEN event_id % 5 IN (0, 3) THEN user_id END AS output_size,
 CASE event_id % 5 WHEN 1 THEN 'SCHEMA_VERSION:expected build-result.v1' WHEN 4 THEN 'INVALID_FORMAT:not a JSON object' WHEN 2 THEN 'INVALID_FORMAT:field output_size'
 ELSE CASE WHEN event_type = 'click' THEN 'INVALID_FORMAT:field source_format' END END AS problem FROM events"""
)
def record_loads(spark, sf_dir):
    """Events as build records: some of an unknown version, some without a field, of a wrong format, or no JSON at all; sizes as numbers and texts."""
    kind, form = F.col("event_id") % 5, F.when(F.col("event_type") == "click", "pdf").otherwise("txt")
    size = F.when(kind == 2, "").when(kind == 3, F.concat(F.lit(',"output_size":"'), "user_id", F.lit('"'))).otherwise(F.concat(F.lit(',"output_size":'), "user_id"))
    version = F.when(kind == 1, "build-result.v9").otherwise("build-result.v1")
    body = F.concat(F.lit('{"schema_version":"'), version, F.lit('","source_format":"'), form, F.lit('","output_sha256":"x","translated_count":1,"preserved_count":0'), size, F.lit("}"))
    texts = table(spark, sf_dir, "events").select("event_id", F.when(kind == 4, "no json").otherwise(body).alias("value"))
    return records.loaded(texts, "build-result.v1").select("event_id", "source_format", "output_size", F.concat_ws(":", "problem.code", "problem.message").alias("said"), "problem").select(
        "event_id", "source_format", "output_size", F.when(F.col("problem").isNotNull(), F.col("said")).alias("problem")
    )
