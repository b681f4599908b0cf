import math
from collections.abc import Mapping
from enum import Enum

import pytest
from pyspark.sql import functions as F

from quirekit.functions import values
from quirekit.operators.translate import OPTIONS


class Colour(Enum):
    RED = ("red", {"deep": 1})


class Broken(Mapping):
    def __getitem__(self, key):
        raise RuntimeError

    def __iter__(self):
        yield "a"

    def __len__(self):
        return 1


def test_loops_and_broken_nests_end():
    loop: dict = {"password": "p1", "x": [{"token": ["t1", {"y": "t2"}]}], "n": None, "secret": None}
    loop["self"], loop["list"] = loop, [loop, "Bearer abc"]
    want = {"password": "[REDACTED]", "x": [{"token": "[REDACTED]"}], "n": None, "secret": "[REDACTED]", "self": "<recursive-reference>", "list": ["<recursive-reference>", "Bearer [REDACTED]"]}
    assert values.redacted_value(loop) == want
    assert values.sensitive_values(loop) == ["p1", "t1", "t2"]
    assert values.json_safe(loop)["self"] == "<recursive-reference>"
    assert values.json_safe({"b": Broken(), "c": 1}) == {"b": {"unsupported_type": "Broken"}, "c": 1}


def test_json_safe():
    loop: list = [1]
    loop.append(loop)
    got = values.json_safe({"a": math.inf, "b": b"xy", "c": loop, "d": object(), 5: (True, None)})
    assert got["a"] == "<non-finite-float>" and got["b"]["binary_size"] == 2
    assert got["c"] == [1, "<recursive-reference>"] and got["d"] == {"unsupported_type": "object"} and got["<int>"] == [True, None]


def test_json_safe_keeps_order_and_shared_parts():
    part = [1]
    got = values.json_safe({"b": part, "a": part, "t": ({"x": -0.5}, {2}), "e": Colour.RED, "1": "text", 1: "number", 2: "last"})
    assert list(got) == ["b", "a", "t", "e", "1", "<int>"] and got["b"] == got["a"] == [1] and got["t"] == [{"x": -0.5}, {"unsupported_type": "set"}]
    assert got["e"] == ["red", {"deep": 1}] and got["1"] == "text" and got["<int>"] == "last"
    assert values.json_safe("x") == "x" and values.json_safe([]) == [] and values.json_safe(math.nan) == "<non-finite-float>"
    deep: list = []
    for _ in range(5000):
        deep = [deep]
    assert values.json_safe(deep)


def test_order_of_sensitive_values():
    nest = {"z": {"secret": "one"}, "password": "two", "list": [{"api_key": "three"}, {"api_key": "one"}], "secret": ["not under a key", ""], "token": "no"}
    assert values.sensitive_values(nest) == ["one", "two", "three", "not under a key", "no"]
    assert values.redacted_value(("password=abc", {"secret": {"a": 1}, "n": None})) == ["password=[REDACTED]", {"secret": "[REDACTED]", "n": None}]


def test_redaction_of_nested_values():
    value = {"Api-Key": "k1", "x": ["Bearer abc.def", {"password": "p"}], "n": 3, "secret": ""}
    assert values.sensitive_values(value) == ["k1", "p"]
    assert values.redacted_value(value) == {"Api-Key": "[REDACTED]", "x": ["Bearer [REDACTED]", {"password": "[REDACTED]"}], "n": 3, "secret": "[REDACTED]"}


@pytest.mark.parametrize("change", [{"target_language": " "}, {"prompt_template": "no text"}, {"prompt_template": "{text}{other}"}, {"model_parameters": {"messages": []}}, {"max_retries": 21}, {"retry_backoff_seconds": math.inf}, {"model_parameters": {"api_key": "x"}}])
def test_policy(change):
    values.check_policy(OPTIONS)
    with pytest.raises(ValueError, match="CONFIGURATION"):
        values.check_policy(OPTIONS | change)


def test_secret_search(spark):
    rows = [(1, b"..s3cret.."), (2, "xs3cret".encode("utf-16")), (3, "s3cret".encode("utf-32-be")), (4, b"s3cre"), (5, bytes.fromhex("0" + b"s3cret".hex() + "0"))]
    frame = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "k int, b binary")
    assert {r[0]: r[1] for r in frame.select("k", values.holds_secret(F.col("b"), "s3cret")).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
