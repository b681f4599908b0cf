import hashlib
import random

from pyspark.sql import functions as F

from quirekit.functions import ids
from quirekit.functions import text as fx
from quirekit.operators import checks, segment, translate


def units(spark, text, limit=1800, options=None):
    return segment.segment_texts(spark.createDataFrame([("d", text)], "k string, text string"), "k", options, limit).orderBy("order").collect()


def test_paragraphs_and_roles(spark):
    rows = units(spark, "Chapter 1\n\n“Hello.\nThere.”\n \t\nLast paragraph.")
    assert [r["source_text"] for r in rows] == ["Chapter 1", "“Hello.\nThere.”", "Last paragraph."]
    assert [r["content_role"] for r in rows] == ["heading", "dialogue", "paragraph"]
    assert "".join(r["source_text"] + r["joiner"] for r in rows) == "Chapter 1\n\n“Hello.\nThere.”\n \t\nLast paragraph."


def test_long_paragraph_is_cut_at_sentences():
    body = "First sentence. Second sentence. Third sentence."
    assert [body[a:b] for a, b in segment.text_cuts(body, 22)] == ["First sentence.", "Second sentence.", "Third sentence."]
    assert segment.text_cuts("x" * 45, 20) == [(0, 20), (20, 40), (40, 45)]
    assert segment.text_cuts("  \n\n  ") == []


def test_cuts_lose_nothing():
    rng = random.Random(5)
    for _ in range(300):
        body = "".join(rng.choice("ab .!?。\n\t　") for _ in range(rng.randrange(0, 200)))
        cuts = segment.text_cuts(body, 17)
        assert all(0 < b - a <= 17 and body[a:b].strip() == body[a:b] for a, b in cuts)
        between = [body[x:y] for x, y in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(body)], strict=True)]
        assert not "".join(between).strip()
        core = body.strip()
        if core:
            parts = segment.slot_cuts(core, 17)
            assert "".join(core[a:c] for a, _, c in parts) == core and all(0 < b - a <= 17 for a, b, _ in parts)


def test_golden_identities(spark):
    sha = "80674ac632a0198318346ac9cb9d995948f9147208b7785bc727a4b21af0900b"
    row = spark.createDataFrame([(sha, "Chapter One")], "s string, t string")
    row = row.withColumn("h", ids.sha_text(F.col("t"))).withColumn("i", ids.txt_segment_id(F.col("s"), F.lit(0), F.lit(11), F.col("h")))
    row = row.withColumn("x", ids.input_hash(F.col("i"), F.col("h"), translate.OPTIONS | {"source_language": "en", "target_language": "zh-CN"})).first()
    assert row["h"] == "3e93ded328010c26b2176cdc15e10c360110a14f9f60379e2d83f093ad3f3e2e"
    assert row["i"] == "ad77c61ed7aca3d5dd6c121a79d971eded60d552bf6ef685bbf3d9c242ea9b05"
    assert row["x"] == "90e492a3af4fdfbc2170e1ec696daf293fd7a564c3722c32e31a93165470f535"
    assert hashlib.sha256(b"Chapter One").hexdigest() == row["h"]


def test_selection_and_precedence(spark):
    segs = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "segment_id string, source_text string")
    had = spark.createDataFrame([("0", "succeeded", "a"), ("1", "failed", None), ("2", "manual", "m"), ("3", "failed", None)], "segment_id string, status string, translated_text string")
    chosen = spark.createDataFrame([("0",), ("1",), ("4",)], "segment_id string")
    got = {r["segment_id"]: (r["status"], r["translated_text"]) for r in translate.translated(segs, selected=chosen, existing=had, sleep=False).collect()}
    assert got == {"0": ("succeeded", "a"), "1": ("succeeded", "[en] text 1"), "2": ("manual", "m"), "3": ("failed", None), "4": ("succeeded", "[en] text 4"), "5": ("source", None)}
    none = spark.createDataFrame([], "segment_id string")
    assert {r["status"] for r in translate.translated(segs, selected=none).collect()} == {"source"}
    wrong = spark.createDataFrame([("zz",)], "segment_id string")
    try:
        translate.translated(segs, selected=wrong)
        raise AssertionError
    except ValueError as e:
        assert "SEGMENT_NOT_FOUND" in str(e) and "zz" in str(e)


def test_retry_and_errors(spark):
    class Flaky:
        id = "flaky"

        def __init__(self):
            self.calls = 0

        def translate(self, text, options):
            self.calls += 1
            if text == "blank":
                return {"text": "  "}
            if text == "crash":
                raise RuntimeError("boom")
            if text == "leak":
                return {"text": "has s3cret"}
            if text == "twice" and self.calls % 3:
                raise translate.ProviderError("PROVIDER_FAILURE", "again", True)
            return {"text": "ok", "usage": {"a": 1, "b": -1, "c": True, "d": "x"}}

    work = spark.createDataFrame([("t", "twice"), ("b", "blank"), ("c", "crash"), ("l", "leak")], "segment_id string, source_text string").coalesce(1)
    got = {r["segment_id"]: r for r in translate.executed(work, Flaky, protected=("s3cret",), sleep=False).collect()}
    assert (got["t"]["status"], got["t"]["attempts"], got["t"]["usage"]) == ("succeeded", 3, {"a": 1})
    assert (got["b"]["attempts"], got["b"]["error"]["code"]) == (3, "OUTPUT_MISSING")
    assert (got["c"]["attempts"], got["c"]["error"]["retryable"]) == (1, False)
    assert got["l"]["error"]["code"] == "OUTPUT_INVALID"


def test_identity_rebuild(spark):
    rows = [("a", "One.\n\nTwo." * 40), ("b", "x")]
    segs = segment.segment_texts(spark.createDataFrame(rows, "k string, text string"), "k", limit=12).withColumn("value", F.col("source_text"))
    got = {r["k"]: r["text"] for r in checks.rebuilt(segs, "k").collect()}
    assert got == dict(rows)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(fx.redact(F.lit("Authorization: Bearer t x; api_key=abc, zz"), ("zz",))) == "Authorization: [REDACTED] [REDACTED] x; api_key=[REDACTED], [REDACTED]"
    assert value(fx.strip(F.lit("\x1c　 a b  \n"))) == "a b"
    assert value(fx.newline_style(F.lit("a\r\nb\rc"))) == "mixed"
    assert value(fx.artifact_stem(F.lit("x/ My book!.v1.txt"))) == "My-book-.v1"
    assert [value(fx.language_tag_ok(F.lit(t))) for t in ("English", "e", "en_US", "en-", "en--US", "en-u", "zh-Hans", "en-a-bbb-a-ccc")] == [False] * 6 + [True, False]
    assert value(fx.prompt("{source_language}>{target_language}|{style}|{text}", F.lit("a"), F.lit("b"), F.lit(""), F.lit("{text}"))) == "a>b||{text}"


def test_texts_are_cut_a_few_at_a_time(spark):
    """What a Python worker holds is bounded by rows of a batch and by what is cut at once, however large a partition is."""
    import pyarrow as pa

    bodies = [None if i % 7 == 0 else "One. Two.\n\nThree. " * (i % 5) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": pa.array(bodies, pa.string())})
    out = list(segment._spans_udf(lambda b: segment.text_cuts(b, 9), 2, ["doc_id"])([batch]))
    assert max(b.num_rows for b in out) <= 64 and out[0].schema.names == ["doc_id", "spans"]
    got = [None if s is None else [(x["start"], x["end"]) for x in s] for b in out for s in b.column("spans").to_pylist()]
    assert got == [None if b is None else segment.text_cuts(b, 9) for b in bodies]
    segment.with_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_places_of_units_are_those_of_the_segments(spark):
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "One. Two three.\n\n Four. " * i) for i in range(20)], "doc_id long, text string")
    places = segment.unit_places(docs, "doc_id", 10)
    want = segment.segment_texts(docs, "doc_id", limit=10).select("doc_id", "order", "start", "end")
    assert places.columns == want.columns and sorted(places.collect()) == sorted(want.collect())
    assert "text" not in places._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n")[0].split("[")[-1]
