"""Tool-call linking: calls meet their results, in the order they depend on one another."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import stored

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problem(value, schema: dict, path: str = "") -> str | None:
    """The first way in which ``value`` breaks ``schema``, or None.

    Understands type, enum, required, properties, additionalProperties (false), items,
    minimum, maximum, minLength and maxLength. A reference to another call's result,
    ``{"$call": id}``, stands for a value of any type.
    """
    if isinstance(value, dict) and set(value) == {"$call"}:
        return None
    kind = schema.get("type")
    if kind and not any(_KINDS[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return f"{path or 'arguments'}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the allowed values"
    for bound, low in (("minimum", True), ("maximum", False)):
        if bound in schema and _KINDS["number"](value) and (value < schema[bound] if low else value > schema[bound]):
            return f"{path}: beyond {bound}"
    for bound, low in (("minLength", True), ("maxLength", False)):
        if bound in schema and isinstance(value, str) and (len(value) < schema[bound] if low else len(value) > schema[bound]):
            return f"{path}: beyond {bound}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{path}{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{path}{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := problem(v, schema["items"], f"{path}[{i}]"))), None)
    return None


def references(value) -> list[str]:
    """Identifiers of the calls whose results the arguments use."""
    if isinstance(value, dict):
        if set(value) == {"$call"} and isinstance(value["$call"], str):
            return [value["$call"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _read(arguments: str | None, name: str | None, schemas: dict[str, dict]) -> tuple[str | None, str | None, list[str]]:
    """(canonical arguments, problem, references) of one call.

    No JSON are also NaN and infinite numbers, halves of surrogate pairs, which no UTF-8 text
    can hold, and values nested deeper than Python's stack.
    """
    try:
        value = json.loads(arguments) if arguments is not None else None
        text, used = canonical(value), sorted(set(references(value)))
        text.encode()
        return text, problem(value, schemas[name]) if name in schemas else "unknown tool", used
    except (ValueError, RecursionError):
        return None, "arguments: not JSON", []


def parsed_calls(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with canonical ``arguments``, ``problem`` (null: valid) and ``uses``."""

    @F.pandas_udf("arguments string, problem string, uses array<string>")
    def read(arguments: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [_read(a, n, schemas) for a, n in zip(arguments, name, strict=True)]
        return pd.DataFrame(rows, columns=["arguments", "problem", "uses"])

    return calls.withColumn("_read", read("arguments", "name")).drop("arguments").select("*", "_read.*").drop("_read")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without known references, else one above the highest of them.

    ``calls`` has unique (conv_id, call_id) and ``uses``. Each round gives a level to the
    calls all of whose references have one, so there are as many rounds as the longest
    chain has links. Calls in or behind a circle never get one and are not in the result.
    References to calls that do not exist are left out. No group of a conversation is
    gathered: every round is a join on (conversation, call).
    """
    edges = calls.select("conv_id", "call_id", F.explode("uses").alias("on")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("on"))
    waiting = stored(edges.join(known, ["conv_id", "on"]), "call-edges")
    blocked = waiting.select("conv_id", "call_id").distinct()
    ready = calls.select("conv_id", "call_id").join(blocked, ["conv_id", "call_id"], "left_anti")
    done = [ready.withColumn("level", F.lit(0))]
    level, left = 0, waiting.count()
    while left:
        last = done[-1].select("conv_id", F.col("call_id").alias("on"))
        rest = stored(waiting.join(last, ["conv_id", "on"], "left_anti"), "call-edges")
        still = rest.select("conv_id", "call_id").distinct()
        level += 1
        freed = waiting.select("conv_id", "call_id").distinct().join(still, ["conv_id", "call_id"], "left_anti")
        done.append(freed.withColumn("level", F.lit(level)))
        waiting, before = rest, left
        left = rest.count()
        if left == before:
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: its place in the order, its state and its canonical JSON.

    ``calls``: conv_id, turn, call_no, call_id, name, arguments (JSON text).
    ``results``: conv_id, turn, call_id, content. Returns conv_id, level, turn, call_no,
    call_id, status, detail, json. Within a conversation (level, turn, call_no, call_id) is
    a topological order: a call comes after all calls whose results it uses.

    status is ``ok``; ``invalid`` (arguments break the schema, are no JSON, or the tool is
    unknown; ``detail`` says how); ``circular`` (in or behind a circle of references; level
    null); ``dangling`` (uses a call that does not exist); or ``unanswered``; the first that
    applies, in the order circular, invalid, dangling, unanswered, ok.

    Calls that repeat a (conv_id, call_id) count once, the earliest by turn, call_no, name
    and arguments; of several results of a call the earliest by turn and content counts.
    Calls or results without conversation or identifier are left out, and so are results
    of unknown calls. A null content is a null result. Empty tables give no rows. Other
    columns do not matter.
    """
    calls = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    order = F.struct("turn", "call_no", "name", "arguments")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(order).alias("c")).select("conv_id", "call_id", "c.*")
    known = stored(parsed_calls(first, schemas), "calls")
    given = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    answer = given.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    leveled = known.join(levels(known), ["conv_id", "call_id"], "left")
    used = known.select("conv_id", "call_id", F.explode("uses").alias("on"))
    targets = known.select("conv_id", F.col("call_id").alias("on"))
    lost = used.join(targets, ["conv_id", "on"], "left_anti").select("conv_id", "call_id", F.lit(True).alias("lost")).distinct()
    linked = leveled.join(lost, ["conv_id", "call_id"], "left").join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("level").isNull(), "circular")
        .when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("lost"), "dangling")
        .when(F.col("answer").isNull(), "unanswered")
        .otherwise("ok")
    )

    @F.pandas_udf("string")
    def serialise(
        call_id: pd.Series, name: pd.Series, arguments: pd.Series, status: pd.Series, content: pd.Series
    ) -> pd.Series:
        def one(i, n, a, s, c):
            row = {"id": i, "name": n, "arguments": None if a is None else json.loads(a), "status": s}
            return canonical(row | ({"result": c} if s not in ("unanswered",) else {}))

        return pd.Series([one(*row) for row in zip(call_id, name, arguments, status, content, strict=True)], dtype=object)

    told = linked.withColumn("status", status)
    return told.select(
        *("conv_id", "level", "turn", "call_no", "call_id", "status"),
        F.when(F.col("status") == "invalid", F.col("problem")).alias("detail"),
        serialise("call_id", "name", "arguments", "status", F.col("answer.content")).alias("json"),
    )
