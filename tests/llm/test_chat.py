"""Linking, order, validation and canonical JSON of tool calls."""

import json

from splicework.llm import chat

SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": [1, "x"]}}}}}


def test_canonical():
    value = {"b": [1.0, 2.5, None, True], "a": {"é": " \n", "": 1e300}, "A": 10**20}
    assert chat.canonical(value) == '{"A":100000000000000000000,"a":{"":1e+300,"é":" \\n"},"b":[1,2.5,null,true]}'
    assert json.loads(chat.canonical(value)) == value


def test_violations():
    told = lambda v: chat.violation(v, SCHEMAS["add"])
    assert told({"a": 1, "b": [1, "x"]}) is None and told({"a": 1.0}) is None
    assert [told(v) for v in ([], {}, {"a": True}, {"a": -1}, {"a": 1, "c": 2}, {"a": 1, "b": [2]})] == ["/type", "/a/required", "/a/type", "/a/minimum", "/c/additionalProperties", "/b/0/enum"]


def test_linked_ordered_and_odd_rows(spark):
    calls = [(1, "c1", 1, "add", '{"a": 1}', "c2"), (1, "c2", 5, "add", '{"a":-1}', None), (1, "c2", 6, "add", '{"a":2}', None), (1, "c3", 2, "sub", "{}", "c1"), (1, "c4", 3, "add", "{", "nowhere"), (1, "c5", 3, "add", '{"a":NaN}', None)]
    calls += [(2, "x", 1, "add", '{"a":1}', "y"), (2, "y", 2, "add", '{"a":1}', "x"), (2, "z", 3, "add", '{"a":1}', "y"), (2, "s", 3, None, None, "s"), (None, "c1", 1, "add", "{}", None), (3, None, 1, "add", "{}", None)]
    calls += [(4, f"n{i}", i, "add", '{"a":1}', f"n{i - 1}" if i else None) for i in range(40)]
    results = [(1, "c1", 2, "two"), (1, "c1", 2, "too"), (1, "lost", 9, None), (2, "z", 4, "ok")]
    messages = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (5, 0, "system", "x" * 200000)]
    made = chat.formatted(
        spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, depth int"),
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMAS,
    ).collect()
    of = {(r.conv_id, r.call_id, r.part): (r.depth, r.status, r.detail) for r in made if r.part}
    assert of[1, "c2", 1] == (0, "invalid", "/a/minimum") and of[1, "c1", 1] == (1, "ok", None) and of[1, "c1", 2] == (1, "ok", None) and of[1, "c3", 1] == (2, "unknown tool", None)
    assert of[1, "c4", 1] == (0, "malformed", None) and of[1, "c5", 1] == (0, "malformed", None) and of[1, "lost", 2] == (None, "orphaned", None)
    assert {of[2, c, 1][1] for c in "xyzs"} == {"circular"} and of[4, "n39", 1] == (39, "unanswered", None)
    assert sum(r.part == 0 for r in made) == 4 and [r.json for r in made if r.part == 2 and r.call_id == "c1"] == ['{"content":"too","id":"c1","type":"result"}']
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(*chat.as_calls(empty), chat.REPLY_TOOL).count() == 0
