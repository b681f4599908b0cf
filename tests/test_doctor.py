"""Planted faults are named; counts and health."""

from quirekit.operators import doctor


def test_planted_faults(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "projects": frame([("p",)], "project_id string"),
        "jobs": frame([("j", "p", "running"), ("lost", "gone", "failed")], "job_id string, project_id string, status string"),
        "artifacts": frame([("a", "p", "k1", 3), ("b", "p", "k1", 3), ("c", "p", "k2", 4), ("d", "p", "k3", 1), ("e", None, None, None)], "artifact_id string, project_id string, storage_key string, size long"),
        "sources": frame([("p", "a"), ("p", "zz")], "project_id string, artifact_id string"),
        "segments": frame([("j",), ("x",), ("x",)], "job_id string"),
    }
    files = frame([("k1", 3), ("k2", 5), ("k9", 1)], "storage_key string, size long")
    wrong = doctor.reconciled(tables, files)
    assert {tuple(r) for r in wrong.collect()} == {
        ("project", "gone", "PROJECT_MISSING", 1), ("artifact", "zz", "ARTIFACT_MISSING", 1), ("job", "x", "JOB_MISSING", 2),
        ("payload", "k2", "PAYLOAD_ALTERED", 1), ("payload", "k3", "PAYLOAD_MISSING", 1), ("payload", "k9", "PAYLOAD_ORPHAN", 0),
    }
    assert tuple(doctor.summary(tables["projects"], tables["jobs"]).first()) == (1, 2, 1)
    checks = doctor.report(spark, str(tmp_path), wrong, {"mock": "ok", "http": "no key"}, {"x": "down"})
    by = {r["name"]: r for r in checks.collect()}
    assert by["data_directory"]["ok"] and by["provider:http"]["optional"] and by["integrity:JOB_MISSING"]["detail"] == "1, first x" and not doctor.healthy(checks)
    orphans = doctor.report(spark, str(tmp_path), wrong.filter("code = 'PAYLOAD_ORPHAN'"), {"mock": "ok"})
    assert doctor.healthy(orphans) and not doctor.healthy(doctor.report(spark, str(tmp_path), wrong.filter("false"), {"mock": "broken"}))
    assert not doctor.writable(spark, "/proc/none")[0]
