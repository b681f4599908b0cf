import random

from pyspark.sql import functions as F

import corpus_pipeline
from quirekit.llm import registry


def test_queries_are_registered():
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{name}" for n, name in enumerate(("matroska", "secrets", "jaccard", "decontamination", "mixing", "katz", "reputation", "substrings", "language", "pii", "codes", "clusters", "runs"), 1))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "mixing"]


def test_checking_sql_is_text():
    import __spark_entry__ as contract

    assert all(isinstance(sql, str) for sql in contract.oracle_sql().values())


def test_stages(make, saved, spark):
    rng = random.Random(2)
    words = {"en": [f"the{chr(97 + i)}th" for i in range(26)], "de": [f"sch{chr(97 + i)}ung" for i in range(26)]}
    text = lambda lang, n=80: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang := ("en", "de")[i % 2]), lang, f"s{i % 3}") for i in range(60)]
    item = text("en", 40)
    rows += [(100, rows[0][1], "en", "s0"), (101, None, "en", "s1"), (102, "12 34", "en", "s1"), (103, text("en") + " " + item, "en", "s2"), (104, text("de") + " mail a@b.cd", None, "s0")]
    sf = saved(documents=make(rows, extra=False), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows_now = docs.collect()
        kept[name] = {r["doc_id"]: r for r in rows_now}
        assert docs.columns == columns + ["size", "source_size", "target", "copies", "taken"] * (name == "mixing")
    clean = set(range(60))
    assert set(kept["language"]) == clean | {100, 103, 104} and kept["language"][104]["lang"] == "de"
    assert set(kept["near_duplicates"]) == clean | {103, 104}
    assert set(kept["decontamination"]) == clean | {104}
    assert kept["pii"][104]["text"].endswith("mail [EMAIL]") and kept["pii"][104]["n_chars"] == len(kept["pii"][104]["text"])
    assert all(r["copies"] in (1, 2) for r in kept["mixing"].values())
    assert all(kept["mixing"][i][c] == kept["pii"][i][c] for i in kept["mixing"] for c in columns)
    assert 104 not in kept["mixing"] or kept["mixing"][104]["text"].endswith("[EMAIL]")
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, sf).collect()} == {(i, r["text"]) for i, r in kept["mixing"].items()}


def test_stages_on_odd_rows(make, saved, spark):
    rng = random.Random(3)
    words = {"en": [f"the{chr(97 + i)}th" for i in range(26)], "de": [f"sch{chr(97 + i)}ung" for i in range(26)]}
    text = lambda lang="en", n=60: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang := ("en", "de")[i % 2]), lang, (None, "s1", "s2")[i % 3]) for i in range(40)]
    item, shared = text("en", 30), text("en", 70)
    long = " ".join(text("de", 60) for _ in range(200))
    rows += [(100, text() + " " + item, "en", "s1"), (100, shared, "en", "s1"), (101, shared, "en", None), (101, shared, "en", None), (None, shared, "en", "s1"), (None, text() + " " + item, None, "s1"), (None, text() + " write a@b.cd", None, "s1")]
    rows += [(102, None, None, None), (None, None, None, None), (103, "", "en", "s1"), (104, long, None, "s2"), (3, rows[3][1], "de", rows[3][3])]
    odd = make(rows).withColumn("facts", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("__quirekit_uid", F.lit("clash")).withColumn("__mixsize", F.lit("clash")).withColumn("copies", F.lit("clash"))
    sf = saved(documents=odd, benchmark=spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string"))
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts[name] = docs.collect()
        called = {c: f"doc_{c}" if name == "mixing" and c in ("size", "copies") else c for c in columns}
        assert docs.columns == list(called.values()) + ["size", "source_size", "target", "copies", "taken"] * (name == "mixing")
        assert all(r[called[c]] == "clash" for r in counts[name] for c in ("label", "pii", "uid", "size", "n", "spans", "__quirekit_uid", "__mixsize", "copies"))
        assert all(r["facts"] == {"a": r["doc_id"]} for r in counts[name])
    texts = lambda name: sorted((str(r["doc_id"]), r["text"]) for r in counts[name])
    assert len(counts["language"]) == len(rows) - 3 and all(r["lang"] in ("en", "de") for r in counts["language"])
    # copies of the shared text: ids 100, 101 (twice) and none; of row 3 one; rows of id 100 with other texts are no copies
    assert len(counts["near_duplicates"]) == len(rows) - 3 - 4 and ("100", shared) in texts("near_duplicates")
    assert len(counts["decontamination"]) == len(counts["near_duplicates"]) - 2 and ("100", shared) in texts("decontamination")
    assert len(counts["pii"]) == len(counts["decontamination"]) and sum("[EMAIL]" in r["text"] for r in counts["pii"]) == 1
    whole = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in counts["pii"]]
    mixed = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in counts["mixing"]]
    assert mixed and set(mixed) <= set(whole) and len(mixed) == len(set(mixed))
    assert all(r["size"] == len(r["text"].split()) and r["taken"] == r["size"] * r["copies"] > 0 for r in counts["mixing"])


def test_stages_on_empty_tables(make, saved, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    sf = saved(documents=make([]), benchmark=none)
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert corpus_pipeline.decontamination(spark, make([(1, "x")]), sf).count() == 1
