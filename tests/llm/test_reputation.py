import duckdb
from pyspark.sql import functions as F

from quirekit.llm import op7_reputation as rep

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://Example.NET/en/x?y#z",
    "http://a.example.net/en",
    "http://a.example.net/en/",
    "https://example.com/de/1",
    "https://badexample.com/de/1",
    "https://x.org/fr/p",
    "http://org/fr/",
    "http://net",
    "http://q.net/",
    "http://b.co.uk/x?u=http://example.net/en/",
    "http://h?x=/en/",
    "ftp://user@host:80/p#f",
    "http://10.0.0.1/a",
    "http://10.0.0.1:8080/b",
    "http://[::1]:80/c",
    "http://www.a.gov.uk:80/d",
]


def test_against_sql(spark, saved):
    pages = [(i, u, "clash") for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i % 7}.spam.example.com/p{i}", "c") for i in range(80)] + [(100, "http://h0.spam.example.com/p0", "c")]
    labels = [(100 + i, None if i % 9 == 0 else int(i % 7 == 3), None if i % 11 == 0 else int(i % 7 < 2)) for i in range(80)] + [(100, 1, 0), (None, 1, 1), (9999, 0, 1)]
    path = saved(pages=spark.createDataFrame(pages, "page_id long, url string, host string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    mine = rep.op7_reputation(spark, path)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    columns = sorted(mine.columns)
    theirs = con.sql(rep.ORACLE).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(repr(tuple(r)) for r in mine.select(*columns).collect()) == sorted(map(repr, theirs))
    got = {r["page_id"]: r for r in mine.collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (4, 5, 8, 10, 11, 12)] == [
        ("example.net", "/en/x", "example.net/en/"), ("a.example.net", "/en", "net/"), ("badexample.com", "/de/1", None), ("org", "/fr/", "org/fr/"), ("net", "", None), ("q.net", "/", "net/"),
    ]
    assert got[100]["verdict"] == "block" and got[103]["verdict"] == "allow"


def test_domains(spark):
    hosts = {"10.0.0.1": ("10.0.0.1", "(address)"), "u@10.0.0.1:80": ("10.0.0.1", "(address)"), "[::1]:8": ("[::1]", "(address)"), "a.gov.uk:80": ("a.gov.uk", "gov.uk"), "x.y.a.com": ("a.com", "com"), "net": ("net", "net"), "": ("", ""), "b.a.k12.xx": ("k12.xx", "xx")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = rep.domain_and_suffix(F.col("host"))
    assert {r["host"]: (r["d"], r["s"]) for r in rows.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts
    domain, suffix = rep.domain_and_suffix(F.col("host"), ("k12.xx",))
    assert rows.filter("host = 'b.a.k12.xx'").select(domain, suffix).first()[:] == ("a.k12.xx", "k12.xx")


def test_without_labels_or_pages(spark, saved):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert rep.op7_reputation(spark, saved(pages=pages, labels=none)).first()["verdict"] == "allow"
    assert rep.op7_reputation(spark, saved(pages=pages.limit(0), labels=none)).count() == 0
