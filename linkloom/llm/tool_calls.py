"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on the call's identifier. Levels order the calls topologically:
calls that depend on no other have level 1, any other one more than the highest level it depends on. Groups of
connected calls are found by joins and each is ordered in one task, if it has a bounded number of
dependencies; larger ones are ordered by joins. Calls of a cycle, and calls that wait for them, get no level. Arguments are checked against the
tool's schema, and call and result become one JSON object with sorted keys and no spare white space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, place, positions, stash
from .simhash import components

#: Dependencies of a connected group of calls up to which one task orders it.
GROUP = 1 << 20

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    out = []
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def canonical(value) -> str:
    """JSON with sorted keys, no spare white space, characters as they are but for half surrogates."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def escaped(text: str) -> str:
    """Half surrogates, which no UTF-8 text can hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` (call_id, …) with result and n_results by a join on call_id.

    A call without a result keeps null and 0. Of results that repeat an identifier the smallest is linked
    and all are counted; results without a call are dropped here and found by an anti join. A null
    identifier links to nothing.
    """
    once = results.groupBy("call_id").agg(F.min("result").alias("result"), F.count("*").alias("n_results"))
    return calls.join(once, "call_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls.select("call_id").distinct(), "call_id", "left_anti")


def levels(dependencies: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, level for the distinct identifiers of ``calls``; dependencies: call_id, needs. Cycles have a null level.

    A dependency on an identifier that no call has, or on null, does not count. Each connected group of
    calls with at most ``GROUP`` dependencies is levelled in one task, however many levels it has; a larger
    one goes through ``_wide_levels``.
    """
    calls = stash(pick(calls, call_id="call_id").filter("call_id IS NOT NULL").distinct(), "calls")
    known = calls.select(F.col("call_id").alias("needs"))
    needs = pick(dependencies, call_id="call_id", needs="needs").distinct().join(known, "needs", "left_semi")
    needs = stash(needs.join(calls, "call_id", "left_semi").select("call_id", "needs"), "needs")
    groups = stash(components(needs.select(F.col("call_id").alias("a"), F.col("needs").alias("b")).filter("a <> b")), "groups")
    # a call that needs itself alone is in no group; it waits for itself
    selfish = needs.filter("call_id = needs").join(groups.select(F.col("node").alias("call_id")), "call_id", "left_anti").select("call_id", F.lit(None).cast("int").alias("level"))
    dealt = stash(needs.join(groups.withColumnRenamed("node", "call_id"), "call_id"), "dealt")
    large = stash(dealt.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("root"), "large")
    kind = dict(calls.dtypes)["call_id"]
    # whole groups in buckets of bounded size: a task of its own for each small group would cost more than its order
    bucket = F.pmod(F.xxhash64("root"), F.lit(1 + dealt.count() // max(1, GROUP // 4))).alias("bucket")
    small = dealt.join(large, "root", "left_anti").select(bucket, "call_id", "needs")
    found = small.groupBy("bucket").applyInPandas(_group_levels, f"call_id {kind}, level int")
    if not large.isEmpty():
        ids = groups.join(large, "root", "left_semi").select(F.col("node").alias("call_id"))
        found = found.unionByName(_wide_levels(stash(ids, "wide"), dealt.join(large, "root", "left_semi").select("call_id", "needs")))
    found = stash(found.unionByName(selfish), "levels")
    free = calls.join(found, "call_id", "left_anti").withColumn("level", F.lit(1))
    return free.unionByName(found)


def _group_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of the calls of whole groups, in topological order; what is left over is on a cycle or waits for one."""
    codes, names = pd.factorize(pd.concat((pdf["call_id"], pdf["needs"]), ignore_index=True))
    one, two = codes[: len(pdf)], codes[len(pdf) :]
    waits = np.bincount(one, minlength=len(names))
    order = np.argsort(two, kind="stable")
    users, starts = one[order].tolist(), np.concatenate(([0], np.cumsum(np.bincount(two, minlength=len(names))))).tolist()
    level, waits = [1] * len(names), waits.tolist()
    ready, done = [i for i, n in enumerate(waits) if not n], [False] * len(names)
    while ready:
        at = ready.pop()
        done[at] = True
        for user in users[starts[at] : starts[at + 1]]:
            level[user] = max(level[user], level[at] + 1)
            waits[user] -= 1
            if not waits[user]:
                ready.append(user)
    found = pd.Series([n if ok else None for n, ok in zip(level, done, strict=True)], dtype="Int32")
    return pd.DataFrame({"call_id": names, "level": found})


def _wide_levels(left: DataFrame, needs: DataFrame) -> DataFrame:
    """Levels of groups too large for a task: by doubling pointers where calls need one other at most, else a round a level."""
    needs = stash(needs, "needs")
    if needs.groupBy("call_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return _chain_levels(left, needs)
    level, done = 0, left.select("call_id", F.lit(None).cast("int").alias("level")).limit(0)
    while True:
        level += 1
        waiting = needs.select("call_id").distinct()
        ready = stash(left.join(waiting, "call_id", "left_anti"), "ready")
        if ready.isEmpty():
            return done.unionByName(left.withColumn("level", F.lit(None).cast("int")))
        done = stash(done.unionByName(ready.withColumn("level", F.lit(level))), "done")
        left = stash(left.join(ready, "call_id", "left_anti"), "calls")
        needs = stash(needs.join(ready.select(F.col("call_id").alias("needs")), "needs", "left_anti"), "needs")


def _chain_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """Levels where every call needs one other at most: rounds grow with the log of the longest chain."""
    at = stash(calls.join(needs, "call_id", "left").select("call_id", F.col("needs").alias("to"), F.lit(1).cast("long").alias("level")), "chain")
    # a chain ends within so many rounds; what points on after them is on a cycle or leads to one
    for _ in range(calls.count().bit_length()):
        if at.filter("to IS NOT NULL").isEmpty():
            break
        ahead = at.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        on, ended = at.filter("to IS NOT NULL").join(ahead, "to"), at.filter("to IS NULL")
        at = stash(on.select("call_id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level")).unionByName(ended), "chain")
    return at.select("call_id", F.when(F.col("to").isNull(), F.col("level")).cast("int").alias("level"))


def _number(text: str):
    raise ValueError(f"{text} is no JSON")


def checked(call_id, name, arguments, result, schemas: dict[str, dict]) -> tuple[list[str], str]:
    """What is wrong with a call, and its canonical JSON. Arguments that are no JSON, or nested beyond what Python reads, stay text."""
    as_text = canonical({"arguments": arguments, "id": call_id, "name": name, "result": result})
    try:
        given = json.loads(arguments, parse_constant=_number) if arguments is not None else None
        schema = schemas.get(name)
        wrong = [f"unknown tool {name}"] if schema is None else violations(given, schema)
        return [escaped(w) for w in wrong], canonical({"arguments": given, "id": call_id, "name": name, "result": result})
    except RecursionError:
        return ["$: nested too deep"], as_text
    except ValueError:
        return ["$: not JSON"], as_text


def _formatted(schemas: dict[str, dict], n_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [checked(*r, schemas) for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
            wrong, text = zip(*rows, strict=True) if rows else ((), ())
            valid = pa.array([not w for w in wrong], pa.bool_())
            out = [*batch.columns[:n_columns], valid, pa.array(list(wrong), pa.list_(pa.string())), pa.array(list(text), pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:n_columns], "valid", "errors", "json"])

    return run


#: Columns that formatting adds.
ADDED = ("result", "n_results", "level", "valid", "errors", "json")


def format_calls(calls: DataFrame, results: DataFrame, dependencies: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per row of ``calls`` (call_id, name, arguments as JSON text): with result, n_results, level, valid, errors, json.

    Arguments that are no JSON (NaN and infinities are none) are invalid and stay text; of a key that
    repeats, the last value counts; a tool without a schema is invalid. Null arguments are checked as null.
    Half surrogates are written as escapes. Other columns of ``calls`` are carried along, but for those
    that are called, in any case, as one that is added here.
    """
    first = ["call_id", "name", "arguments"]
    places = [place(calls, c) for c in first]
    others = [i for i, c in enumerate(calls.columns) if i not in places and c.lower() not in {*ADDED, *first}]
    flat = positions(calls).select(*(F.col(f"_{i}").alias(c) for i, c in zip(places, first, strict=True)), *(f"_{i}" for i in others))
    linked = link(flat, pick(results, call_id="call_id", result="result")).join(levels(dependencies, flat), "call_id", "left")
    linked = linked.select(*first, "result", "n_results", "level", *(f"_{i}" for i in others))
    schema = ", ".join(f"`{c}` {t}" for c, t in linked.dtypes) + ", valid boolean, errors array<string>, json string"
    out = linked.mapInArrow(_formatted(schemas, len(linked.columns)), schema)
    return out.toDF(*first, "result", "n_results", "level", *(calls.columns[i] for i in others), "valid", "errors", "json")


#: The tool that a conversation's user turns call.
REPLY = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of a table (conv_id, turn, role, text).

    A user turn calls the tool ``reply`` under the identifier conversation:turn, an assistant turn is the
    result of the turn before it, and a call depends on the call two turns before it.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    calls = turns.filter("role = 'user'").select(name(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), "conv_id", "turn")
    results = turns.filter("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("result"))
    needs = turns.filter("role = 'user'").select(name(0).alias("call_id"), name(2).alias("needs"))
    return calls, results, needs
