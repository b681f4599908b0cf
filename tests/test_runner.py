"""Jobs through the stateful stream: states as the fold's, controls, retries, interruption, restarts."""

import pytest
from pyspark.sql import functions as F

from quirekit.operators import jobs
from quirekit.schemas import JOB_MOVES, PIPELINES
from quirekit.streaming import runner
from quirekit.streaming.runner import CONTROL, RESULT, SUBMIT, JobRun, message


def finished(orders):
    """A handler that is done with every order, partly where the job's name says so."""
    step = F.col("step")
    status = F.when(F.col("job_id").contains("part") & (step == "translate_text"), "partially_succeeded").when(F.col("job_id").contains("bad") & (step == "segment_text") & (F.col("try") < 6), "failed").otherwise("succeeded")
    return orders.filter("job_id not like '%lost%' or step <> 'extract_text'").select("job_id", status.alias("status"), F.array("step").alias("outputs"), F.when(status == "failed", "INVALID_FORMAT").alias("code"))


HANDLERS = {step: finished for steps in PIPELINES.values() for step, _ in steps}


def states(spark, folder):
    return {r["job_id"]: r["status"] for r in jobs.folded(runner.job_events(spark, folder)).collect()}


def test_jobs_run_to_their_ends(spark, tmp_path):
    folder = str(tmp_path)
    runner._made(spark, f"{folder}/messages/sent")
    runner.sent(spark, folder, [message("a", word="novel_txt_v1"), message("part", word="novel_epub_v1"), message("bad", word="novel_txt_v1"), message("lost", word="novel_txt_v1"), message("m", word="manga_full_v1"), message("x", word="none"), message(None, word="manga_full_v1")])
    assert runner.drained(spark, folder, HANDLERS) > 5
    assert states(spark, folder) == {"a": "succeeded", "part": "partially_succeeded", "bad": "failed", "lost": "failed", "m": "succeeded"}
    steps = runner.step_events(spark, folder)
    assert [r["step"] for r in steps.filter("job_id = 'a' and status = 'succeeded'").orderBy("seq").collect()] == [s for s, _ in PIPELINES["novel_txt_v1"]]
    assert steps.filter("job_id = 'lost' and status = 'failed'").first()["code"] == "OUTPUT_MISSING"
    runner.sent(spark, folder, [message("bad", CONTROL, "retry"), message("a", CONTROL, "retry"), message("m", SUBMIT, "manga_full_v1")])
    runner.drained(spark, folder, HANDLERS)  # a new query from the checkpoint
    assert states(spark, folder)["bad"] == "failed" and states(spark, folder)["a"] == "succeeded"
    runner.sent(spark, folder, [message("bad", CONTROL, "retry")] * 1)
    runner.sent(spark, folder, [message("bad", CONTROL, "retry")])
    runner.drained(spark, folder, HANDLERS)
    bad = runner.step_events(spark, folder).filter("job_id = 'bad'")
    assert bad.filter("step = 'detect_encoding' and status = 'succeeded'").count() == 1  # what was done isn't done again
    folded = jobs.folded(runner.job_events(spark, folder).filter("seq > 0"))  # the fold begins with queued
    assert folded.filter("refused > 0").isEmpty()  # the stream makes no move the table forbids


def test_a_handler_that_raises_fails_its_jobs(spark, tmp_path):
    def broken(orders):
        raise RuntimeError("no")

    folder = str(tmp_path)
    runner._made(spark, f"{folder}/messages/sent")
    runner.sent(spark, folder, [message("a", word="manga_full_v1")])
    runner.drained(spark, folder, {"prepare_manga": broken})
    assert states(spark, folder) == {"a": "failed"} and runner.job_events(spark, folder).filter("status = 'failed'").first()["code"] == "RuntimeError"


def test_interruption(spark, tmp_path, monkeypatch):
    """An order whose result never comes runs into its timer."""
    folder = str(tmp_path)
    runner._made(spark, f"{folder}/messages/sent")
    runner.sent(spark, folder, [message("a", word="manga_full_v1")])
    quiet = {"prepare_manga": lambda orders: orders.sparkSession.createDataFrame([], "none int")}
    none = lambda orders, done, error="": orders.filter("false").select(*[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in runner.MESSAGES.split(", "))])
    monkeypatch.setattr(runner, "_results", none)
    runner.settled(runner.run_jobs(spark, folder, quiet, patience=0.001), idle=4)
    assert states(spark, folder) == {"a": "failed"}
    assert runner.job_events(spark, folder).filter("status = 'failed'").first()["code"] == "PROCESS_INTERRUPTED"


def test_a_table_of_messages(spark):
    """The same processor over a whole table gives the states that the fold of its events gives."""
    rows = [(f"j{i}", SUBMIT, "manga_full_v1") for i in range(20)] + [(f"j{i}", CONTROL, ("pause", "cancel", "resume", "x")[i % 4]) for i in range(0, 24)]
    frame = spark.createDataFrame([message(*r) for r in rows], "job_id string, kind string, word string, step string, try int, outputs array<string>, code string")
    made = runner.answers(frame.withColumn("at", F.when(F.col("kind") == SUBMIT, F.lit(0)).otherwise(F.lit(60)).cast("timestamp"))).collect()
    assert sum(r["kind"] == "order" for r in made) == 20 and sum(r["kind"] == "refused" for r in made) == 4 + 5 + 5
    assert sum(r["status"] == "cancelling" and r["kind"] == "event" for r in made) == 5


def test_tables_are_folded_without_a_state_store(spark):
    """What the jobs' messages give one by one, in any order of rows; no call of a state store a job, which takes milliseconds."""
    rows = []
    for i in range(300):
        rows += [(f"j{i}", SUBMIT, "manga_full_v1", None, None, None, 0), (f"j{i}", RESULT, "succeeded", "prepare_manga", 1, None, 1 + i % 3)]
        rows += [(f"j{i}", CONTROL, ("pause", "cancel", "resume")[i % 3], None, None, None, 2), (f"j{i}", RESULT, "failed", "translate_manga", 2, f"c{i % 2}", 3), (f"j{i}", None, None, None, None, None, None)]
        rows += [(f"j{i}", RESULT, "failed", "translate_manga", 2, "c1", 3)] * (i % 2)
    rows.append((None, SUBMIT, "manga_full_v1", None, None, None, 0))
    frame = spark.createDataFrame(rows[::-1], "job_id string, kind string, word string, step string, try int, code string, at long").withColumn("at", F.col("at").cast("timestamp"))
    made = runner.answers(frame)
    assert "TransformWithState" not in made._jdf.queryExecution().toString()
    want = []
    for job in sorted({r[0] for r in rows if r[0]}):
        run = JobRun()
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[6] is None, r[6], r[1] or "", r[3] or "", r[4] or 0, r[2] or "", r[5] or "")):
            run.take(*r[1:6])
        want += [(job, i, *a) for i, a in enumerate(run.answers)]
    assert [tuple(r) for r in made.orderBy("job_id", "seq").collect()] == want
    assert runner.answers(frame.filter("false")).isEmpty()


def played(*messages):
    run, out = JobRun(), []
    for m in messages:
        run = JobRun(run.held())
        run.take(*m)
        out += run.answers
    return run, out


def test_controls_take_effect_at_the_end_of_a_step():
    done = lambda step, n: (RESULT, "succeeded", step, n)
    run, _ = played((SUBMIT, "manga_full_v1"), (CONTROL, "pause"), done("prepare_manga", 1))
    assert run.status == "paused"
    run, out = played((SUBMIT, "manga_full_v1"), (CONTROL, "pause"), done("prepare_manga", 1), (CONTROL, "resume"), done("translate_manga", 2), done("translate_manga", 2))
    assert run.status == "running" and run.step == "export_manga" and out[-1][0] == "refused"
    run, _ = played((SUBMIT, "manga_full_v1"), (CONTROL, "cancel"), done("prepare_manga", 1))
    assert run.status == "cancelled"
    run, out = played((SUBMIT, "manga_full_v1"), (CONTROL, "cancel"), (RESULT, "failed", "prepare_manga", 1, "X"), (CONTROL, "resume"))
    assert run.status == "failed" and out[-1][0] == "refused"
    run, _ = played((CONTROL, "pause"), (SUBMIT, "manga_full_v1"), (SUBMIT, "manga_full_v1"), ("odd", None), done("prepare_manga", 7))
    assert run.status == "running" and run.step == "prepare_manga"


@pytest.mark.parametrize("seed", range(30))
def test_random_messages_never_break_the_table_of_moves(seed):
    import random

    r = random.Random(seed)
    run, status = JobRun(), None
    for _ in range(80):
        kind = r.choice([SUBMIT, CONTROL, RESULT, RESULT, RESULT, "expired"])
        word = {SUBMIT: r.choice([*PIPELINES, "none"]), CONTROL: r.choice(["pause", "cancel", "resume", "retry", "x"]), RESULT: r.choice(["succeeded"] * 6 + ["failed", "partially_succeeded", "cancelled", "odd"])}.get(kind)
        run = JobRun(run.held())
        run.take(kind, word, run.step if r.random() < 0.9 else "odd", run.tries if r.random() < 0.9 else 0)
        for what, now, step, *_ in run.answers:
            if what == "event" and step is None:
                assert now == "queued" if status is None else now in JOB_MOVES[status]
                status = now
        assert status == run.status
