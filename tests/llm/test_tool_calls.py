"""Levels of calls against a plain longest path, and calls that no JSON text can hold as they are."""

import json
import random
import re

import pytest

from linkloom.llm import tool_calls


def plain_levels(ids, needs):
    """Level of each identifier, None on a cycle or behind one."""
    of = {i: {b for a, b in needs if a == i and b in ids} for i in ids}
    found, level = {}, 0
    while True:
        level += 1
        ready = [i for i in of if i not in found and all(b in found for b in of[i])]
        if not ready:
            return {i: found.get(i) for i in ids}
        found.update(dict.fromkeys(ready, level))


def graph(seed):
    rng = random.Random(seed)
    ids = [f"c{i}" for i in range(160)]
    needs = [(f"c{i}", f"c{i - 1}") for i in range(1, 40)] + [(f"c{i}", f"c{i - 2}") for i in range(2, 40)]  # a ladder: two needs a call
    needs += [(f"c{i}", f"c{rng.randrange(40, i)}") for i in range(41, 120) for _ in range(rng.randint(0, 3))]
    needs += [("c130", "c131"), ("c131", "c130"), ("c132", "c130"), ("c133", "c133"), ("c134", "gone"), ("c135", None), (None, "c1"), ("gone", "c1")]
    return ids, needs


@pytest.mark.parametrize("group", [0, 1 << 20])
def test_levels_against_a_plain_order(spark, monkeypatch, group):
    monkeypatch.setattr(tool_calls, "GROUP", group)
    ids, needs = graph(3)
    if not group:  # a round a level beyond the bound: shorter
        ids, needs = ids[36:], [n for n in needs if not (n[0] or "").startswith("c1") or len(n[0] or "") < 4 or n[0] >= "c130"]
    calls = spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "call_id string")
    found = {r["call_id"]: r["level"] for r in tool_calls.levels(spark.createDataFrame(needs, "call_id string, needs string"), calls).collect()}
    assert found == plain_levels(ids, needs)


def test_chains_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "GROUP", 0)
    ids = [f"{i}" for i in range(50)]
    needs = [(f"{i}", f"{i - 1}") for i in range(1, 40)] + [("40", "41"), ("41", "42"), ("42", "40"), ("43", "42")]
    calls = spark.createDataFrame([(i,) for i in ids], "call_id string")
    found = {r["call_id"]: r["level"] for r in tool_calls.levels(spark.createDataFrame(needs, "call_id string, needs string"), calls).collect()}
    assert found == plain_levels(ids, needs)


def test_odd_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = {"half": '{"a":"\\ud800"}', "key": '{"\\udc00":1}', "deep": deep, "nan": '{"a":NaN}', "huge": '{"a":1e999}', "twice": '{"a":1,"a":"x"}', "none": '{"a":null}', "list": '{"a":[]}'}
    calls = spark.createDataFrame([(k, "t", v) for k, v in texts.items()], "call_id string, name string, arguments string")
    schemas = {"t": {"type": "object", "properties": {"a": {"type": ["string", "null"]}}, "additionalProperties": False}}
    empty = spark.createDataFrame([], "call_id string, result string")
    rows = {r["call_id"]: r for r in tool_calls.format_calls(calls, empty, empty.withColumnRenamed("result", "needs"), schemas).collect()}
    assert {k for k, r in rows.items() if r["valid"]} == {"half", "twice", "none"}
    assert rows["list"]["errors"] == ["$.a: not of type string or null"] and rows["key"]["errors"] == ["$.\\udc00: unknown"]
    assert rows["deep"]["errors"] == ["$: nested too deep"] and rows["nan"]["errors"] == rows["huge"]["errors"] == ["$: not JSON"]
    for k, r in rows.items():
        read = json.loads(r["json"])  # every row is JSON, with the arguments or their text
        assert read["arguments"] == (texts[k] if k in ("deep", "nan", "huge") else json.loads(texts[k])) and not re.search(": ", r["json"].split('"arguments"')[0])


def test_clashing_columns(spark):
    calls = spark.createDataFrame([("a", "t", "{}", 7, "x", "y", 1)], "call_id string, name string, arguments string, level int, Result string, node string, turn int")
    results = spark.createDataFrame([("a", "r", "z")], "call_id string, result string, name string")
    needs = spark.createDataFrame([("a", "a2", 1)], "call_id string, needs string, level int")
    row = tool_calls.format_calls(calls, results, needs, {"t": {}}).first().asDict()
    assert row == {"call_id": "a", "name": "t", "arguments": "{}", "result": "r", "n_results": 1, "level": 1, "node": "y", "turn": 1, "valid": True, "errors": [], "json": '{"arguments":{},"id":"a","name":"t","result":"r"}'}
