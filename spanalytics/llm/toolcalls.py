"""Chat formatting: links tool calls to their results, orders them, checks their arguments and writes canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). Calls may name others that they need; a call's
level is one more than the highest level that it needs, found by rounds that settle every call whose needs are settled
(a round is one join and one aggregation over the calls still open, so the rounds are as many as the longest chain).
Calls on a cycle or behind one never settle and keep a null level. Arguments are checked against the tool's schema, a
subset of JSON Schema: type, required, properties, additionalProperties, enum, minimum, minLength and items.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, functions as F

from . import common

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, by path."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, (int, float)) and value < schema.get("minimum", value):
        out.append(f"{at}: too small")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole floats as integers, and characters as they are, but for lone surrogates."""

    def plain(v):
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return valid_text(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def valid_text(s: str) -> str:
    """The text with lone surrogates, which UTF-8 can't hold, as JSON escapes."""
    return s.encode("utf-8", "backslashreplace").decode()


def _finite(s: str) -> float:
    if not math.isfinite(x := float(s)):
        raise ValueError(f"not a finite number: {s}")
    return x


def parsed(text: str | None):
    """A JSON value; ValueError for NaN and infinities, which JSON hasn't, and for what is nested too deeply to be written."""
    text = text or ""
    try:
        value = json.loads(text, parse_constant=_finite, parse_float=_finite)
        if text.count("[") + text.count("{") > 200:
            canonical([[value]])
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return value


def levels(calls: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(conv, call_id, level) for calls (conv, call_id, needs array): 0 for a call that needs none. A need that is no
    call of the conversation is ignored; a call on a cycle, or behind one, is left out. Goes on until nothing new settles;
    where ``most_rounds`` is given and isn't enough, it raises."""
    ids = calls.select("conv", "call_id").distinct()
    edges = calls.select("conv", F.col("call_id").alias("to"), F.explode("needs").alias("call_id")).distinct().join(ids, ["conv", "call_id"], "left_semi")
    edges = common.materialize(edges, "needs")
    waiting = edges.select("conv", F.col("to").alias("call_id")).distinct()
    done = common.materialize(ids.join(waiting, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    open_ = edges.isEmpty()
    out, level = done, 0
    while not open_:
        if level == most_rounds:
            raise RuntimeError("levels did not settle")
        level += 1
        marked = edges.join(out.select("conv", "call_id", F.lit(True).alias("ok")), ["conv", "call_id"], "left")
        ready = marked.groupBy("conv", F.col("to").alias("call_id")).agg(F.every(F.coalesce("ok", F.lit(False))).alias("all")).filter("all").select("conv", "call_id")
        fresh = common.materialize(ready.join(out, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(level)), "levels")
        open_ = fresh.isEmpty()
        out = common.materialize(out.union(fresh), "levels")
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per pair of call and result with equal (conv, call_id), and per call or result without partner.

    calls: (conv, call_id, turn, name, arguments as JSON text, needs array<string>); results: (conv, call_id, turn, content).
    Gives conv, call_id, call_turn, result_turn, status (linked, unanswered, orphan), level, valid, problems and json.
    Identifiers that repeat pair each call with each of their results, so their number is the product of theirs within one
    identifier only. A null conv or call_id links with nothing. JSON that can't be read (or is nested too
    deeply to be written) or isn't an object, and an unknown tool, are problems of the call; unread arguments stay in the
    output as text. An orphan result has none and isn't valid.
    """
    c = calls.select("conv", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", F.lit(True).alias("is_call"))
    r = results.select("conv", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("is_result"))
    both = c.join(r, ["conv", "call_id"], "full_outer").join(levels(calls), ["conv", "call_id"], "left")
    conv = calls.schema["conv"].dataType.simpleString()
    turn = calls.schema["turn"].dataType.simpleString()
    schema = f"conv {conv}, call_id string, call_turn {turn}, result_turn {turn}, status string, level int, valid boolean, problems array<string>, json string"

    def run(it):
        for batch in it:
            rows = batch.to_pylist()
            out = {f: [] for f in ("conv", "call_id", "call_turn", "result_turn", "status", "level", "valid", "problems", "json")}
            for x in rows:
                found, args = [], x["arguments"]
                if x["is_call"]:
                    try:
                        args = parsed(x["arguments"])
                        found = ["$: unknown tool"] if x["name"] not in schemas else [valid_text(p) for p in problems(args, schemas[x["name"]])]
                    except ValueError:
                        found = ["$: not JSON"]
                status = "linked" if x["is_call"] and x["is_result"] else "unanswered" if x["is_call"] else "orphan"
                shape = {"status": status}
                if x["is_call"]:
                    shape["call"] = {"id": x["call_id"], "name": x["name"], "arguments": args}
                if x["is_result"]:
                    shape["result"] = {"id": x["call_id"], "content": x["content"]}
                for f, v in {"status": status, "valid": bool(x["is_call"]) and not found, "problems": found, "json": canonical(shape)}.items():
                    out[f].append(v)
                for f in ("conv", "call_id", "call_turn", "result_turn", "level"):
                    out[f].append(x[f])
            yield out

    return common.arrow(both, run, schema)


#: The tool of the conversations' query.
REPLY = {"type": "object", "required": ["role", "text", "turn"], "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def conversation_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads a conversation as tool use: a user's turn is a call of the tool ``reply`` with the identifier conv:turn and
    needs the conversation's first call; another turn that isn't the system's is the result for the turn before it."""
    rows = rows.select("conv_id", "turn", "role", "text")
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    turn = F.col("turn")
    asked = rows.filter("role = 'user' and conv_id is not null and turn is not null")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first"))
    args = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    calls = asked.join(first, "conv_id").select(F.col("conv_id").alias("conv"), ident(turn).alias("call_id"), "turn", F.lit("reply").alias("name"), args.alias("arguments"), F.when(turn > F.col("first"), F.array(ident(F.col("first")))).otherwise(F.array().cast("array<string>")).alias("needs"))
    answered = rows.filter("(role is null or role not in ('user', 'system')) and conv_id is not null and turn is not null")
    results = answered.select(F.col("conv_id").alias("conv"), ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
