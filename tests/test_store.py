"""Deletion in two phases, and commits of which one of two wins."""

import threading
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirekit.operators import commits, deletion
from quirekit.sources import sinks, stores

NONE = timedelta(seconds=-3600)  # any file is old enough


@pytest.fixture()
def world(spark, tmp_path):
    """Two projects that share a payload, an orphan and a file half written."""
    folder = str(tmp_path / "store")
    bodies = spark.createDataFrame([(1, bytearray(b"shared")), (2, bytearray(b"own of a")), (3, bytearray(b"own of b")), (4, bytearray(b"orphan"))], "key int, content binary")
    keys = {r["key"]: r["storage_key"].removeprefix(folder + "/") for r in sinks.store_payloads(bodies, folder, 100).collect()}
    (Path(folder) / ".pending-x").write_bytes(b"half")
    artifacts = spark.createDataFrame([("a", keys[1]), ("a", keys[2]), ("b", keys[1]), ("b", keys[3]), ("b", None)], "project_id string, storage_key string")
    jobs = spark.createDataFrame([("a", "succeeded"), ("b", "running")], "project_id string, status string")
    projects = spark.createDataFrame([("a",), ("b",)], "project_id string")
    return folder, keys, {"projects": projects, "jobs": jobs, "artifacts": artifacts}


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_listing(spark, world):
    folder, keys, _ = world
    found = {r["storage_key"]: (r["size"], r["pending"]) for r in stores.listing(spark, f"file:{folder}").collect()}
    assert {k: found[k] for k in keys.values()} == {keys[1]: (6, False), keys[2]: (8, False), keys[3]: (8, False), keys[4]: (6, False)}
    assert stores.listing(spark, folder + "/none").isEmpty()


def test_refusals(world):
    _, _, tables = world
    with pytest.raises(ValueError, match="confirmation.*'artifacts': 2"):
        deletion.without_project(tables, "a")
    with pytest.raises(ValueError, match="1 active jobs"):
        deletion.without_project(tables, "b", True)
    with pytest.raises(ValueError, match="NOT_FOUND"):
        deletion.without_project(tables, "c", True)


def test_mark_and_sweep(spark, world):
    folder, keys, tables = world
    left = deletion.without_project(tables, "a", True)
    assert left["projects"].count() == 1 and left["artifacts"].count() == 3
    had = tables["artifacts"].filter("project_id = 'a'")
    marks = deletion.marked(stores.listing(spark, folder), left["artifacts"], had)
    assert {(r["storage_key"], r["reason"]) for r in marks.collect()} == {(keys[2], "deleted")}  # the rest is too young
    marks = deletion.marked(stores.listing(spark, folder), left["artifacts"], had, grace=NONE)
    assert {(r["storage_key"], r["reason"]) for r in marks.filter("reason <> 'pending'").collect()} == {(keys[2], "deleted"), (keys[4], "orphan")}
    # between the phases the orphan finds a use
    used = left["artifacts"].unionByName(spark.createDataFrame([("b", keys[4])], "project_id string, storage_key string"))
    out = {r["storage_key"]: r["outcome"] for r in deletion.swept(marks, used, folder).collect()}
    assert out[keys[2]] == "deleted" and out[keys[4]] == "kept"
    assert files(folder) - {".pending-x"} == {keys[1], keys[3], keys[4]}
    again = {r["storage_key"]: r["outcome"] for r in deletion.swept(marks, left["artifacts"], folder).collect()}
    assert again[keys[2]] == "missing" and again[keys[4]] == "deleted"
    bad = spark.createDataFrame([("../x",), ("/etc/x",), ("",)], "storage_key string")
    assert {r["outcome"] for r in stores.deleted(bad, folder).collect()} == {"refused"}


def test_of_two_writers_one_fails(spark, tmp_path):
    table = commits.Versions(spark, str(tmp_path / "t"), "job_id string, n int, text string")
    assert table.version == 0 and table.read().isEmpty()
    rows = lambda job, *ns: spark.createDataFrame([(job, n, f"{job}{n}") for n in ns], "job_id string, n int, text string")
    one = lambda *jobs: spark.createDataFrame([(j,) for j in jobs], "job_id string")
    assert table.commit(rows("a", 1, 2).unionByName(rows("b", 1)), one("a", "b"), 0) == 1
    outcome = []

    def writer(n):
        try:
            outcome.append(table.commit(rows("a", n, n + 1, n + 2), one("a"), 1))
        except commits.Conflict:
            outcome.append("conflict")

    both = [threading.Thread(target=writer, args=(n,)) for n in (10, 20)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(map(str, outcome)) == ["2", "conflict"]
    now = {(r["job_id"], r["n"]) for r in table.read().collect()}
    assert ("b", 1) in now and {n for j, n in now if j == "a"} in ({10, 11, 12}, {20, 21, 22})
    assert len(stores.names(spark, f"{table.root}/data")) == 2  # the loser left nothing
    assert {(r["job_id"], r["n"]) for r in table.read(1).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert table.commit(rows("b"), one("b"), 2) == 3 and table.read().filter("job_id = 'b'").isEmpty()
    with pytest.raises(commits.Conflict):
        table.commit(rows("b", 5), one("b"), 2)
    with pytest.raises(ValueError, match="INVALID_STATE"):
        table.commit(rows("c", 1), one("b"), 3)
    assert table.replace(one("b"), lambda had: had.filter("job_id = 'a'").select(F.lit("b").alias("job_id"), "n", "text")) == 4
    assert table.read().filter("job_id = 'b'").count() == 3
