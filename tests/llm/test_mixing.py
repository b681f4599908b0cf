import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quirekit.llm import op5_mixing


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by rounds of resharing, as the rule says it."""
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, out, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        total = sum(w[n] for n in free)
        for n in free:
            out[n] += left * w[n] / total
        left = 0.0
        for n in list(free):
            if out[n] >= 2 * sizes[n]:
                left += out[n] - 2 * sizes[n]
                out[n] = 2.0 * sizes[n]
                free.discard(n)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_targets_and_taken(make, spark, saved, small, monkeypatch):
    if small:
        monkeypatch.setattr(op5_mixing, "PARTS", 3)
    rows = [(i, "w " * (1 + (i * 7919) % 40), "en", [None, "a", "b", "c", "é", "Z"][i % 11 if i % 11 < 6 else 1]) for i in range(3000)]
    rows += [(10_000, None, "en", "a"), (10_001, "", "en", "b"), (5, rows[5][1], "en", rows[5][3]), (None, "x y", "en", "a")]
    path = saved(documents=make(rows))
    got = op5_mixing.op5_mixing(spark, path).collect()
    again = op5_mixing.op5_mixing(spark, path).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, longest = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        longest[s] = max(longest.get(s, 0), r["size"])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    want = targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_complete_epochs_come_first(make):
    rows = [(i, "w " * 10, "en", "a") for i in range(50)] + [(i, "w " * 10, "en", "b") for i in range(100, 400)]
    got = op5_mixing.mixed(make(rows)).groupBy("source").agg(F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
    assert all(r["high"] - r["low"] <= 1 for r in got)


def drawn(k, text, seed=17):
    body = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    u = (int(hashlib.md5(f"{seed}:{'' if k is None else k}:{body}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    size, n_bytes = len(words), len(body.encode())
    quality = max(math.exp(-abs(n_bytes / max(size, 1) - 6.5) / 6.5) * size / (size + 20), 0.01)
    return size, -math.log(u) / quality


@pytest.mark.parametrize("grid", [(8, 256, 4), (1, 2, 1)])
def test_against_plain_efraimidis_spirakis(make, grid, monkeypatch):
    for name, value in zip(("GRID", "PARTS", "LEVELS"), grid, strict=True):
        monkeypatch.setattr(op5_mixing, name, value)
    text = lambda i: "x" if i % 3 == 0 else f"longer words {i} " * (1 + i % 30) if i % 3 == 1 else "y " * (i % 200)
    rows = [(i, text(i), "en", ("a", "b", None)[i % 7 % 3]) for i in range(2500)]
    got = {r["doc_id"]: r["copies"] for r in op5_mixing.mixed(make(rows)).collect()}
    sizes = {}
    for k, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + drawn(k, t)[0]
    want = targets(sizes)
    for source, whole in sizes.items():
        full, spent = want[source] // whole, 0
        own = sorted((drawn(k, t)[1], k, drawn(k, t)[0]) for k, t, _, s in rows if s == source)
        for _, k, size in own:
            spent += size
            assert got[k] == (full + (spent - size / 2 <= want[source] - full * whole) if size else 0)


def test_quality_weighs_the_chance(make):
    rows = [(i, "words of usual length " * 20 if i % 2 else "x " * 80, "en", "a") for i in range(3000)]
    rows += [(i, "words of usual length " * 20, "en", "b") for i in range(5000, 9000)]
    got = op5_mixing.mixed(make(rows), weights=(1.0, 1.0), share=0.5).filter("source = 'a'").groupBy(F.pmod("doc_id", F.lit(2)).alias("good")).agg(F.avg("copies").alias("mean")).collect()
    mean = {r["good"]: r["mean"] for r in got}
    assert mean[1] > mean[0] + 0.1


def test_one_word_texts_have_keys_of_their_own(make):
    rows = make([(i, "w") for i in range(20_000)], extra=False)
    sized, p = op5_mixing.sized(rows)
    keyed = sized.withColumn("key", F.col(f"{p}key")).cache()
    assert keyed.select("key").distinct().count() == 20_000
    assert keyed.groupBy(*op5_mixing.bins(F.col("key"))).count().agg(F.max("count")).first()[0] <= 3


def test_sql_agrees(make, saved, spark):
    rows = [(i, "w " * (1 + (i * 7919) % 40), "en", [None, "a", "b", "c"][i % 4]) for i in range(500)] + [(900, None, "en", "a"), (901, "", "en", "d"), (None, "x y", "en", "a")]
    path = saved(documents=make(rows))
    mine = sorted(repr((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in op5_mixing.op5_mixing(spark, path).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    theirs = con.sql(f"select doc_id, size, source_size, target, taken from ({op5_mixing.ORACLE})").fetchall()
    assert mine == sorted(map(repr, theirs))


def test_empty(make, spark, saved):
    assert op5_mixing.op5_mixing(spark, saved(documents=make([]))).count() == 0
    got = op5_mixing.op5_mixing(spark, saved(documents=make([(1, None), (2, "")]))).collect()
    assert [r["taken"] for r in got] == [0, 0]
