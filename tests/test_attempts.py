"""Steps that lose no finished call: killed tasks, restarts, cancellation, and the events of all kinds."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirekit.operators import attempts, translate
from quirekit.operators import runtime as rt

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests
QUICK = {"retry_backoff_seconds": 0.0}


class Counting:
    """Notes every call in a file; dies once, in the middle of a task, where it is told to."""

    id = "counting"

    def __init__(self, folder, dies_at=None):
        self.folder, self.dies_at = folder, dies_at

    def translate(self, text, options):
        with open(f"{self.folder}/calls", "a") as out:
            out.write(text + "\n")
        if text == self.dies_at and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)  # the worker is gone, as with a lost executor
        if text.startswith("bad"):
            raise translate.ProviderError("PROVIDER_FAILURE", "no", True)
        return {"text": text.upper(), "usage": {"n": 1}}


def calls(folder):
    with open(f"{folder}/calls") as f:
        return f.read().split()


def segments(spark, n, bad=()):
    rows = [(f"book{i % 2}", i // 2, f"s{i:03}", f"{'bad' if i in bad else 't'}{i:03}") for i in range(n)]
    return spark.createDataFrame(rows + [("book9", 0, "s001", "t001"), ("book9", 1, None, "x")], "key string, `order` int, segment_id string, source_text string").coalesce(1)


def test_a_killed_task_repeats_no_finished_call(spark, tmp_path):
    folder, log = str(tmp_path), str(tmp_path / "log")
    made = [Counting(folder, "t030")]
    # local masters try a task once: the whole step fails, and is started again
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        try:
            attempts.resumed(segments(spark, 40), log, lambda: made[0], QUICK, every=1)
            raise AssertionError("the task should have died")
        except AssertionError:
            raise
        except Exception as e:  # noqa: BLE001
            assert "Python worker exited" in str(e) or "crashed" in str(e), str(e)
        records, status = attempts.resumed(segments(spark, 40), log, lambda: made[0], QUICK, by=["key"], every=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = records.collect()
    assert len(found) == 41 and all(r["translated_text"] == r["source_text"].upper() for r in found)
    assert {(r["key"], r["order"]) for r in found} == {(f"book{i % 2}", i // 2) for i in range(40)} | {("book9", 0)}
    done = calls(folder)
    assert done.count("t030") == 2 and len(done) == 41  # only the call that died was made again
    assert {r["key"]: r["status"] for r in status.collect()} == {"book0": "succeeded", "book1": "succeeded", "book9": "succeeded"}


def test_an_attempt_reads_the_log_of_its_task(tmp_path):
    log = attempts.CallLog(str(tmp_path), "r", 3)
    assert log.finished() == {}
    call = {"segment_id": "a", "status": "succeeded", "translated_text": "A", "provider_id": "p", "model": None, "attempts": 1, "usage": {"n": 2}, "error": None, "events": []}
    log.add([call])
    (tmp_path / "run=r" / "task=3" / "_half.parquet").write_bytes(b"torn")
    again = attempts.CallLog(f"file:{tmp_path}", "r", 3).finished()
    assert list(again) == ["a"] and again["a"]["translated_text"] == "A" and attempts.CallLog(str(tmp_path), "r", 4).finished() == {}


def test_a_step_goes_on_and_keeps_failures(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    factory = lambda: Counting(folder)
    _, status = attempts.resumed(segments(spark, 6, bad=(3,)), log, factory, QUICK)
    assert status.first()["status"] == "partially_succeeded" and len(calls(folder)) == 5 + 3
    records, status = attempts.resumed(segments(spark, 10, bad=(3,)), log, factory, QUICK)
    assert len(calls(folder)) == 8 + 4 + 3 and records.count() == 11 and records.filter("reused").count() == 6
    assert status.first()["worked"] == 5
    token = rt.CancellationToken(str(tmp_path / "tokens" / "t"))
    token.cancel()
    records, status = attempts.resumed(segments(spark, 12, bad=(3,)), log, factory, QUICK, token)
    assert {r["segment_id"] for r in records.filter("status = 'cancelled'").collect()} == {"s003", "s010", "s011"} and status.first()["status"] == "partially_succeeded"
    fresh, status = attempts.resumed(segments(spark, 4), str(tmp_path / "other"), factory, QUICK, token)
    assert status.first()["status"] == "cancelled" and fresh.filter("attempts = 0").count() == 5


def test_events_of_all_kinds(spark, tmp_path):
    log = str(tmp_path / "log")
    token = rt.CancellationToken(str(tmp_path / "tokens" / "t"))
    records, _ = attempts.resumed(segments(spark, 6, bad=(3,)).filter("key <> 'book9'"), log, lambda: Counting(str(tmp_path)), QUICK)
    events = attempts.progress_events(records, "key").orderBy("key", "seq").collect()
    one = [r for r in events if r["key"] == "book1"]
    assert [r["kind"] for r in one].count("retry") == 2 and one[0]["kind"] == "started" and one[-1]["kind"] == "completed" and one[-1]["message"] == "partially_succeeded"
    assert [r["completed"] for r in one if r["kind"] == "progress"] == [1, 2, 3] and {r["total"] for r in one} == {3}
    assert {r["kind"] for r in events} == {"started", "retry", "succeeded", "failed", "progress", "completed"}
    token.cancel()
    more, _ = attempts.resumed(segments(spark, 2), str(tmp_path / "other"), lambda: Counting(str(tmp_path)), QUICK, token)
    assert attempts.progress_events(more, "key").filter("kind = 'cancelled'").count() == 3
    # the log is told twice, as by a batch that was written again: each event comes once
    again = spark.read.schema(attempts.LOG).option("recursiveFileLookup", "true").parquet(log)
    n = attempts.call_events(again).count()
    again.write.parquet(f"{log}/run=again")
    query = attempts.event_stream(spark, log).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("told").count() == n == spark.table("told").select("event_id").distinct().count()


def test_addresses_are_dealt_out_once(spark):
    """Nulls, repeated units and further columns, with one exchange of units and entries, by document."""
    from quirekit.operators import addressing

    units = [(1, 0, "k0", "t0", "a"), (1, 0, "k0", "t0", "a"), (1, 1, "k1", None, None), (1, None, "k0", "t0", "c"), (None, 0, "k0", "t0", "d"), (2, 0, None, "t0", "e"), (2, 1, "k1", "t1", "f")]
    entries = [(1, "number", "0", None), (1, "text", "0", "no"), (1, "text", "k0", "no"), (1, "text", "k1", "x"), (1, "text", "k1", "y"), (None, "text", "k0", "no"), (2, "tuple", "t0", "z"), (2, None, "1", "no"), (2, "text", None, "no"), (2, "tuple", "0", "no")]
    made = addressing.addressed(
        spark.createDataFrame(units, "doc long, sequence int, locator_key string, locator_tuple string, more string"), spark.createDataFrame(entries, "doc long, kind string, address string, value string")
    )
    assert made.columns == ["doc", "sequence", "locator_key", "locator_tuple", "more", "value"]
    want = [(*u, v) for u, v in zip(units, [None, None, "y", None, None, "z", None], strict=True)]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    final = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # the adaptive plan shows both
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final
