import pytest
from pyspark.sql import functions as F

from quirekit.operators import jobs, translate, workspace
from quirekit.schemas import PIPELINES
from quirekit.sources import archives
from quirekit.streaming import watch


def test_text_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b'Chapter One\r\n\r\n"Hello there."\r\n\r\nLast line.\r\n')
    (tmp_path / "b.txt").write_bytes(b"first\n\n[[MOCK_FAIL]]\n\nlast")
    (tmp_path / "bad.txt").write_bytes(b"")
    docs = workspace.inspect_documents(spark, str(tmp_path))
    segs = workspace.extract_segments(docs).cache()
    assert segs.count() == 6
    records, status = workspace.translate_segments(segs, options={"target_language": "zh-CN", "retry_backoff_seconds": 0.0})
    assert sorted(r["status"] for r in status.collect()) == ["partially_succeeded", "succeeded"]
    out = {r["text"]: (r["translated"], r["preserved"]) for r in workspace.rebuild_documents(records).collect()}
    assert out == {'[zh-CN] Chapter One\n\n[zh-CN] "Hello there."\n\n[zh-CN] Last line.\n': (3, 0), "[zh-CN] first\n\n[[MOCK_FAIL]]\n\n[zh-CN] last": (2, 1)}
    done = records.filter("status = 'succeeded'").select("segment_id", "status", "translated_text")
    _, again = workspace.translate_segments(segs.join(done, "segment_id", "left_semi"), existing=done)
    assert {r["status"] for r in again.collect()} == {"noop"}


def test_copies_keep_their_own_records(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "calls")
    folder.mkdir()

    class Counting:
        """Notes its calls in a file and answers some texts with themselves."""

        id = "counting"

        def translate(self, text, options):
            with open(log, "a") as out:
                out.write(text + "\n")
            return {"text": text if text == "same" else f"T {text}"}

    for name in ("a.txt", "b.txt", "c.txt"):
        (folder / name).write_bytes(b"Para a.\n\nPara b.\n\nsame" if name != "c.txt" else b"Para c.")
    segs = workspace.extract_segments(workspace.inspect_documents(spark, str(folder)))
    assert segs.count() == 7 and translate.repeated_ids(segs, "key").count() == 0 and translate.repeated_ids(segs).count() == 3
    records, status = workspace.translate_segments(segs, Counting)
    assert records.count() == 7
    built = {r["key"].rsplit("/", 1)[1]: (r["text"], r["translated"], r["preserved"]) for r in workspace.rebuild_documents(records, segs).collect()}
    whole = ("T Para a.\n\nT Para b.\n\nsame", 3, 0)  # a result equal to its source is a result
    assert built == {"a.txt": whole, "b.txt": whole, "c.txt": ("T Para c.", 1, 0)}
    assert {(r["status"], r["selected"]) for r in status.collect()} == {("succeeded", 3), ("succeeded", 1)}
    calls = (tmp_path / "calls").read_text().splitlines()
    assert sorted(calls) == ["Para a.", "Para b.", "Para c.", "same"]


def test_rows_repeated_in_a_document_are_refused(spark):
    segs = spark.createDataFrame([("d", "1", "x"), ("d", "1", "x")], "key string, segment_id string, source_text string")
    with pytest.raises(ValueError, match="INVALID_FORMAT"):
        workspace.translate_segments(segs)


def test_records_of_other_sources_are_refused(spark):
    kinds = "segment_id string, status string, translated_text string, source_hash string, translation_input_hash string"
    segs = spark.createDataFrame([("1", "h1", "i1"), ("2", "h2", "i2"), ("3", "h3", "i3"), ("4", "h4", "i4")], "segment_id string, source_hash string, translation_input_hash string")
    rows = [("1", "succeeded", "t", "h1", "i1"), ("2", "succeeded", "t", "old", "i2"), ("3", "succeeded", "t", "h3", "old"), ("4", "manual", "t", "", "old"), ("9", "succeeded", "t", "h9", "i9")]
    found = {tuple(r) for r in translate.rejected(segs, spark.createDataFrame(rows, kinds)).collect()}
    assert found == {("2", "SOURCE_MISMATCH"), ("3", "SOURCE_MISMATCH"), ("9", "SEGMENT_NOT_FOUND")}
    bare = spark.createDataFrame([("1", "succeeded", None, "h1", "i1"), ("2", "failed", None, "h2", "i2")], kinds)
    assert [tuple(r) for r in translate.rejected(segs, bare).collect()] == [("1", "INVALID_FORMAT")]


def test_one_call_from_files_to_texts(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"One.\r\n\r\nTwo.")
    (folder / "bad.txt").write_bytes(b"")
    got = workspace.translate_documents(spark, str(folder), target)
    assert [(r["text"], r["translated"]) for r in got["built"].collect()] == [("[en] One.\n\n[en] Two.", 2)]
    assert [r["status"] for r in got["status"].collect()] == ["succeeded"] and got["manifest"].filter("error is not null").count() == 1
    assert got["left_out"].count() == 1 and got["left_out"].first()["code"] is not None
    with pytest.raises(ValueError, match="OUTPUT_CONFLICT"):
        workspace.translate_documents(spark, str(folder), str(folder))
    changed = got["manifest"].withColumn("source_size", F.lit(1).cast("long"))
    assert {r["difference"] for r in workspace.changed_sources(changed, got["manifest"]).collect()} == {"changed"}


def test_pages_end_to_end(spark):
    from test_archives import png, zipped

    rows = [("s", "a.cbz", bytearray(zipped([("2.png", png(2)), ("1.png", png())])))]
    pages = archives.pages(spark.createDataFrame(rows, "source_sha256 string, filename string, content binary"))
    done = workspace.translate_pages(pages, workspace.EchoAdapter)
    assert workspace.page_status(done).first()["status"] == "succeeded"
    assert archives.build_archives(done).first()["translated"] == 2


def test_pages_are_tried_again(spark):
    from test_archives import png, zipped

    rows = [("s", "a.cbz", bytearray(zipped([("1.png", png()), ("2.png", png(2)), ("3.png", png(3))])))]
    pages = archives.pages(spark.createDataFrame(rows, "source_sha256 string, filename string, content binary"))
    refuse = translate.ProviderError

    class Flaky:
        """Fails once for the second page, always for the third, each in its way."""

        def __init__(self):
            self.seen = {}

        def translate_image(self, image, name, options):
            self.seen[name] = self.seen.get(name, 0) + 1
            if name.startswith("2") and self.seen[name] == 1:
                raise refuse("PROVIDER_FAILURE", "again", True)
            return b"no image" if name.startswith("3") else image

    class Sick(Flaky):
        def health(self):
            return "down"

    got = {r["name"]: (r["status"], r["attempts"], r["error_code"]) for r in workspace.translate_pages(pages, Flaky, sleep=False).collect()}
    assert got == {"1.png": ("succeeded", 1, None), "2.png": ("succeeded", 2, None), "3.png": ("failed", 3, "OUTPUT_MISSING")}
    hidden = workspace.translate_pages(pages, workspace.EchoAdapter, protected=(b"PNG",), sleep=False).collect()
    assert {(r["error_code"], r["attempts"]) for r in hidden} == {("OUTPUT_INVALID", 1)}
    assert {(r["error_code"], r["attempts"], r["error_message"]) for r in workspace.translate_pages(pages, Sick).collect()} == {("ADAPTER_UNAVAILABLE", 0, "down")}
    assert workspace.unmatched_pages(pages, pages).count() == 0
    fewer = pages.filter("name <> '2.png'")
    assert [r["difference"] for r in workspace.unmatched_pages(pages, fewer).collect()] == ["missing"]
    assert [r["difference"] for r in workspace.unmatched_pages(fewer, pages.unionByName(fewer)).collect() if r["order"] == 1] == ["unlisted"]


def test_pipelines(spark):
    assert all(abs(sum(w for _, w in steps) - 1) < 1e-9 for steps in PIPELINES.values())
    made = jobs.exploded_steps(spark.createDataFrame([(1, jobs.default_pipeline("novel", "epub"))], "job_id int, pipeline string"), jobs.pipeline_steps(spark))
    assert [r["step"] for r in made.orderBy("position").collect()] == [s for s, _ in PIPELINES["novel_epub_v1"]]


def test_state_folds(spark):
    moves = [(1, 1, "running"), (1, 2, "paused"), (1, 3, "queued"), (1, 4, "running"), (1, 5, "succeeded"), (1, 6, "running"), (2, 1, "succeeded")]
    got = {r["job_id"]: (r["status"], r["refused"], r["final"]) for r in jobs.folded(spark.createDataFrame(moves, "job_id int, seq int, status string")).collect()}
    assert got == {1: ("succeeded", 1, True), 2: ("queued", 1, False)}
    steps = spark.createDataFrame([(1, 1, "running"), (1, 2, "failed"), (1, 3, "pending")], "step_id int, seq int, status string")
    assert jobs.folded_steps(steps).first()["status"] == "pending"


def test_controls(spark):
    rows = spark.createDataFrame([("queued",), ("running",), ("paused",), ("succeeded",)], "status string")
    ask = lambda what: [r[0] for r in rows.select(jobs.controlled(F.col("status"), what)).collect()]
    assert ask("pause") == ["paused", "running", "paused", "succeeded"]
    assert ask("cancel") == ["cancelled", "cancelling", "cancelled", "succeeded"]
    assert ask("resume") == ["queued", "running", "queued", "succeeded"]
    with pytest.raises(ValueError):
        jobs.controlled(F.col("status"), "explode")
    assert [r["status"] for r in jobs.recovered(rows).collect()] == ["queued", "failed", "paused", "succeeded"]


def test_watched_folder(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "One.\n\nTwo."), ("b", None), ("copy", "One.\n\nTwo.")], "doc_key string, text string").write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        query = watch.watch(spark, source, out, str(tmp_path / "check"), once=True)
        query.awaitTermination()
    records = spark.read.parquet(out).filter("doc_key = 'a'")
    assert spark.read.parquet(out).filter("doc_key = 'copy'").count() == 2
    assert [r["translated_text"] for r in records.orderBy("order").collect()] == ["[en] One.", "[en] Two."]
    assert [r["completed"] for r in watch.progress_events(records).orderBy("order").collect()] == [1, 2]
