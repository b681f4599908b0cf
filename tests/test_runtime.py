import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from quirekit.operators import runtime as rt
from quirekit.operators import translate

POLICY = translate.OPTIONS | {"target_language": "de"}
SOURCE = {"source_sha256": "ab", "filename": "a.txt", "source_size": 3}


def test_projects_and_jobs(spark):
    made = rt.new_project(spark, " A book ", "novel", SOURCE, POLICY)
    project = made["projects"].first()
    assert project["name"] == "A book" and len(project["project_id"]) == 36
    assert made["profiles"].first()["project_id"] == project["project_id"] and json.loads(made["profiles"].first()["policy"])["target_language"] == "de"
    job = rt.new_job(made["projects"], made["profiles"], "novel_txt_v1")
    row = job["jobs"].first()
    assert [r["job_id"] for r in job["events"].collect()] == [row["job_id"]] and job["steps"].filter("step_status = 'pending'").count() == 6
    for bad in ({"name": ""}, {"kind": "x"}, {"name": "password=hunter2"}, {"policy": POLICY | {"max_retries": 99}}):
        with pytest.raises(ValueError, match="CONFIGURATION"):
            rt.new_project(spark, **({"name": "n", "kind": "novel", "source": SOURCE, "policy": POLICY} | bad))
    with pytest.raises(ValueError, match="unknown pipeline"):
        rt.new_job(made["projects"], made["profiles"], "none")
    none = spark.createDataFrame([], "project_id string")
    active = spark.createDataFrame([(project["project_id"], "running")], "project_id string, status string")
    assert rt.deletable(made["projects"], {"sources": made["sources"]}, active.filter("false"), project["project_id"])["sources"].count() == 0
    with pytest.raises(ValueError, match="ACTIVE_JOBS: 1"):
        rt.deletable(made["projects"], {}, active, project["project_id"])
    with pytest.raises(ValueError, match="PROJECT_NOT_FOUND"):
        rt.deletable(none, {}, active, "x")


def test_nested_rows_are_bounded(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, name string, pos int")
    got = {r["k"]: [x["name"] for x in r["kids"]] for r in rt.nested(parents, "k", 2, kids=(rows, ["name"], ["pos"])).collect()}
    assert got == {1: ["a", "b"], 2: []}
    with pytest.raises(Exception, match="TOO_MANY: kids"):
        rt.nested(parents, "k", 1, kids=(rows, ["name"], ["pos"])).collect()


def test_migrations_go_forward_only(spark):
    rows = spark.createDataFrame([(4,), (1,)], "schema_version int")
    steps = {1: lambda d: d, 2: lambda d: d}
    with pytest.raises(Exception, match="UNSUPPORTED_SCHEMA: 4"):
        rt.migrated(rows, steps).collect()
    with pytest.raises(ValueError, match="MIGRATION_MISSING: 2"):
        rt.migrated(rows, {1: lambda d: d})


def test_settings_and_addresses(monkeypatch, spark):
    monkeypatch.setenv("N", "7")
    assert rt.setting("N", 1, int, 0, 10) == 7 and rt.setting("M", 1.5, float) == 1.5
    for kind, value in ((int, "x"), (int, "11"), (float, "nan")):
        monkeypatch.setenv("N", value)
        with pytest.raises(ValueError, match="CONFIGURATION"):
            rt.setting("N", 1, kind, 0, 10)
    assert rt.checked_endpoint("https://h/v1/") == "https://h/v1"
    for bad in ("ftp://h", "http://u:p@h", "http://h?x=1", "http://", "h"):
        with pytest.raises(ValueError):
            rt.checked_endpoint(bad)
    rows = spark.createDataFrame([("2020-01-01",), (None,)], "d string").select(rt.started_at(F.col("d").cast("timestamp")).alias("t"))
    assert rows.filter("t is null").count() == 0 and rows.filter("t = timestamp'2020-01-01'").count() == 1


def test_registry():
    registry = rt.Registry()
    registry.register("mock", translate.MockProvider)

    def broken():
        raise OSError("token=abc")

    registry.register("bad", broken)
    assert registry.health() == {"bad": "OSError: token=abc", "mock": "ok"} and registry.factory("mock") is translate.MockProvider
    for action in (lambda: registry.register("mock", broken), lambda: registry.register("No", broken), lambda: registry.factory("x")):
        with pytest.raises(ValueError):
            action()


class _Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *rest):
        self.close()


def test_http_provider(monkeypatch):
    monkeypatch.setenv("KEY", "s3cret")
    seen = []

    def opener(request, timeout):
        seen.append((request.full_url, request.headers, json.loads(request.data)))
        return _Answer(json.dumps({"choices": [{"message": {"content": "Hallo"}}], "model": "m2", "usage": {"total_tokens": 3, "x": True}}).encode())

    got = rt.HttpProvider("http://h/v1/", "m", "KEY", opener=opener).translate("Hello {style}", POLICY | {"model_parameters": {"temperature": 0}})
    assert got == {"text": "Hallo", "model": "m2", "usage": {"total_tokens": 3}}
    url, headers, body = seen[0]
    assert url == "http://h/v1/chat/completions" and headers["Authorization"] == "Bearer s3cret" and body["temperature"] == 0
    assert body["messages"][0]["content"].endswith("Hello {style}")

    def failing(error):
        def opener(request, timeout):
            raise error

        return rt.HttpProvider("http://h", "m", opener=opener)

    http = lambda n: urllib.error.HTTPError("u", n, "x", {}, None)
    for error, code, again in ((http(503), "MODEL_API", True), (http(401), "MODEL_API", False), (http(429), "RATE_LIMIT", True), (urllib.error.URLError("x"), "MODEL_API", True), (urllib.error.URLError(TimeoutError()), "TIMEOUT", True), (TimeoutError(), "TIMEOUT", True)):
        with pytest.raises(translate.ProviderError) as e:
            failing(error).translate("t", POLICY)
        assert (e.value.code, e.value.retryable) == (code, again)
    with pytest.raises(translate.ProviderError, match="no text"):
        rt.HttpProvider("http://h", "m", opener=lambda r, timeout: _Answer(b"{}")).translate("t", POLICY)
    with pytest.raises(translate.ProviderError, match="is not set"):
        rt.HttpProvider("http://h", "m", "NO_SUCH_KEY").translate("t", POLICY)
    with pytest.raises(translate.ProviderError, match="reserved"):
        rt.HttpProvider("http://h", "m").translate("t", POLICY | {"model_parameters": {"model": "x"}})


def test_a_registry_chooses_by_capability_and_health():
    class Made:
        def __init__(self, told):
            self.told = told

        def health(self):
            return self.told

    known = rt.Registry()
    known.register("sick", lambda: Made("models are missing"), ["translate_page"])
    known.register("broken", lambda: 1 / 0, ["translate_page"])
    known.register("well", lambda: Made("ok"), ["translate_page", "ocr"])
    known.register("plain", lambda: object())
    assert known.chosen("translate_page") == "well" and known.health()["sick"] == "models are missing" and known.health()["plain"] == "ok"
    assert known.factory("well", "ocr")().told == "ok"
    for wrong in (lambda: known.factory("sick", "ocr"), lambda: known.chosen("none"), lambda: known.factory("x")):
        with pytest.raises(ValueError):
            wrong()
