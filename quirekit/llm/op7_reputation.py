"""URL filter by host reputation, shrunk from host to registered domain to suffix.

Built-in functions only. A page's outcome is bad where its label says toxic or of no quality. Counts of outcomes by host
roll up to registered domains and suffixes. At each level a beta prior is centred on the level above; its strength is
the beta-binomial moment estimate over that level's units. A host is blocked by the method where the lower bound of its
posterior bad rate exceeds a limit (mean less Z standard deviations of the beta posterior). Rules on host and path go first: the longest that fits decides.

Pages meet the labels and the host verdicts once each, with ids and hosts only; counts are combined before they shuffle.

Defined results: a null url, or one without ``://``, has empty host and path, and is judged as the empty host; pages
without a label and hosts without labelled pages take the prior; labels with two nulls, or for no page, are ignored;
several labels of a page count as one, bad if any is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Two-part suffixes under which names are registered, unless a caller brings its own list; others have one part.
TWO_PART = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "com.tr", "com.tw", "co.za")
#: What stands for the suffix of numeric addresses, which have no names above them.
ADDRESS = "(address)"
#: Standard deviations below the posterior mean, and the bad rate above which a host is blocked.
Z, LIMIT = 1.645, 0.5
#: Bounds of the intra-class correlation, so that a prior is worth between about 1/9 and 999 pages.
RHO = (0.001, 0.9)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; empty without ``://``."""
    body = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(body, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(body, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", "")


def domain_and_suffix(host: Column, two_part=TWO_PART) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a numeric address is its own domain."""
    bare = bare_host(host)
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    two = F.substring_index(bare, ".", -2).isin(*two_part) if two_part else F.lit(False)
    domain = F.when(address, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return domain, F.when(address, ADDRESS).when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the labelled pages."""
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def _strength(units: DataFrame) -> DataFrame:
    """One row: what a unit's prior is worth in pages, by the method of moments over units (n, b)."""
    sums = units.filter("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("bb"))
    mu = F.col("b") / F.col("n")
    var = mu * (1 - mu)
    rho = (F.col("bb") - F.col("b") * mu - (F.col("k") - 1) * var) / ((F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)) * var)
    rho = F.when((var > 0) & (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1) > 0), rho).otherwise(RHO[0])
    held = F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1]))
    return sums.select(F.coalesce(mu, F.lit(0.0)).alias("mu"), (1 / held - 1).alias("s"))


def host_reputation(pages: DataFrame, labels: DataFrame, limit: float = LIMIT, z: float = Z, two_part=TWO_PART) -> DataFrame:
    """(host, n, b, rate, low, verdict) of every host among ``pages`` (page_id, host)."""
    seen = pages.select("page_id", "host").join(outcomes(labels), "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
    domain, suffix = domain_and_suffix(F.col("host"), two_part)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    # Each of these three is one row.
    of = {name: F.broadcast(_strength(units).select(F.col("mu").alias(f"mu_{name}"), F.col("s").alias(f"s_{name}"))) for name, units in (("h", hosts), ("d", domains), ("x", suffixes))}
    top = suffixes.join(of["x"]).select("suffix", ((F.col("b") + F.col("s_x") * F.col("mu_x")) / (F.col("n") + F.col("s_x"))).alias("rate_x"))
    mid = domains.join(top, "suffix").join(of["d"]).select("domain", "suffix", ((F.col("b") + F.col("s_d") * F.col("rate_x")) / (F.col("n") + F.col("s_d"))).alias("rate_d"))
    low = hosts.join(mid, ["domain", "suffix"]).join(of["h"])
    total = F.col("n") + F.col("s_h")
    rate = (F.col("b") + F.col("s_h") * F.col("rate_d")) / total
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))
    return (
        low.select("host", "n", "b", rate.alias("rate"), total.alias("total"))
        .withColumn("low", bound)
        .select("host", "n", "b", "rate", "low", F.when(F.col("low") > limit, "block").otherwise("allow").alias("reputation"))
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, two_part=TWO_PART) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of every page."""
    host, path = url_parts(F.col("url"))
    parts = once(pages.select("page_id", "url"), "u", F.struct(host.alias("host"), path.alias("path"))).select("page_id", "u.host", "u.path")
    known = host_reputation(parts, labels, two_part=two_part).select(F.col("host").alias("known"), "rate", "low", "reputation")
    judged = parts.join(known, F.col("host") == F.col("known"), "left").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("reputation"), F.lit("allow")).alias("verdict"),
        F.round("rate", 6).alias("bad_rate"),
        F.round("low", 6).alias("bad_bound"),
    )


def op7_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; see the module's defined results."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_TWO = ", ".join(f"'{x}'" for x in TWO_PART)


def _strength_sql(units: str) -> str:
    return f"""(SELECT coalesce(b / n, 0) AS mu, 1 / least(greatest(CASE WHEN b / n * (1 - b / n) > 0 AND n - nn / n - (k - 1) > 0
      THEN (bb - b * (b / n) - (k - 1) * (b / n * (1 - b / n))) / ((n - nn / n - (k - 1)) * (b / n * (1 - b / n))) ELSE {RHO[0]} END, {RHO[0]}), {RHO[1]}) - 1 AS s
      FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(n * n)::DOUBLE AS nn, sum(b * b / n)::DOUBLE AS bb FROM {units} WHERE n > 0))"""


ORACLE = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
bad AS (
  SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts1 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS bare FROM parts LEFT JOIN bad USING (page_id) GROUP BY host),
hosts0 AS (SELECT *, string_split(bare, '.') AS p, regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(bare, '[') AS address FROM hosts1),
hosts AS (
  SELECT host, n, b, CASE WHEN address THEN bare WHEN array_to_string(p[-2:], '.') IN ({_TWO}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN address THEN '{ADDRESS}' WHEN array_to_string(p[-2:], '.') IN ({_TWO}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM hosts0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY 1),
top AS (SELECT suffix, (b + s * mu) / (n + s) AS rate FROM suffixes, {_strength_sql('suffixes')}),
mid AS (SELECT domain, d.suffix, (b + s * rate) / (n + s) AS rate FROM domains d JOIN top USING (suffix), {_strength_sql('domains')}),
low AS (SELECT host, (b + s * rate) / (n + s) AS rate, n + s AS total FROM hosts h JOIN mid USING (domain, suffix), {_strength_sql('hosts')}),
known AS (SELECT host, rate, rate - {Z} * sqrt(rate * (1 - rate) / (total + 1)) AS low FROM low),
hit AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, hit.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate, round(low, 6) AS bad_bound
FROM hit LEFT JOIN known ON hit.host = known.host
"""
