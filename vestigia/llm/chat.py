"""Chat formatting with linked tool calls.

An assistant message may be a JSON object with ``tool_calls``, a list of objects
with ``id``, ``name`` and ``arguments``; a message of role ``tool`` a JSON object with
``tool_call_id`` and ``content``. Calls and results are hash-joined by conversation and
identifier. A call that mentions ``{"$ref": id}`` in its arguments depends on the result
of that id; levels order messages topologically: plain messages and free calls stand on
level 0, a result one above its call, a call one above the results it depends on.
Arguments are checked against the schema of the tool's name. Each message becomes one
line of canonical JSON: sorted keys, no spaces, calls by id.

Rows are messages, so a conversation of any length is never gathered in one place.

Defined cases: null, empty and other texts are plain content; malformed JSON stays
plain; of calls with the same id the first by turn and place counts; results without a
call and calls without a result are marked unlinked; a call in a cycle of references
or with one that is never met has a null level; calls without a string id stay in the line, are
invalid and link nothing; further fields of messages and calls stay in the line; a tool without schema accepts any object; null ids of conversations
or turns link nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def valid(value, schema: dict) -> bool:
    """Whether a value meets a schema of type, properties, required, additionalProperties, items and enum."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(valid(v, known[k]) for k, v in value.items() if k in known)
    return all(valid(v, schema["items"]) for v in value) if isinstance(value, list) and "items" in schema else True


def references(value) -> set[str]:
    if isinstance(value, dict):
        own = {value["$ref"]} if isinstance(value.get("$ref"), str) else set()
        return own.union(*(references(v) for v in value.values()))
    return set().union(*(references(v) for v in value)) if isinstance(value, list) else set()


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[list[tuple], str | None, str]:
    """Calls as (id, name, valid, references), the id that a result answers, and the line without links."""
    found, calls, answers, body = _object(text), [], None, {"role": role, "content": text}
    if found and role == "assistant" and isinstance(found.get("tool_calls"), list):
        for c in found["tool_calls"]:
            one = c if isinstance(c, dict) else {}
            own, name, arguments = one.get("id"), one.get("name"), one.get("arguments")
            usable = isinstance(own, str)
            good = usable and isinstance(arguments, dict) and valid(arguments, schemas.get(name, {}) if isinstance(name, str) else {})
            calls.append((own if usable else None, str(name), good, sorted(references(arguments))))
        if calls:
            body = found | {"role": role, "content": found.get("content"), "tool_calls": sorted(({"id": None, "name": None, "arguments": None} | c if isinstance(c, dict) else c for c in found["tool_calls"]), key=canonical)}
    elif found and role == "tool" and isinstance(found.get("tool_call_id"), str):
        answers = found["tool_call_id"]
        body = found | {"role": role, "content": found.get("content")}
    return calls, answers, canonical(body)


CALL = "array<struct<call_id:string,name:string,valid:boolean,refs:array<string>>>"


def parsed(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    call = pa.list_(pa.struct([("call_id", pa.string()), ("name", pa.string()), ("valid", pa.bool_()), ("refs", pa.list_(pa.string()))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(r.as_py(), t.as_py(), schemas) for r, t in zip(batch.column(2), batch.column(3), strict=True)]
            calls = [[dict(zip(("call_id", "name", "valid", "refs"), c, strict=True)) for c in r[0]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(calls, call), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["conv_id", "turn", "role", "calls", "answers", "line"],
            )

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"conv_id long, turn long, role string, calls {CALL}, answers string, line string")


def linked(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Per message: conv_id, turn, role, n_calls, n_invalid, n_linked, level, line."""
    rows = materialize(parsed(messages, schemas or {}), "chat")
    each = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("place", "c")).select("conv_id", "turn", "place", "c.call_id", "c.valid", "c.refs").where(F.col("call_id").isNotNull())
    calls = materialize(each.groupBy("conv_id", "call_id").agg(F.min_by(F.struct("turn", "valid", "refs"), F.struct("turn", "place")).alias("c")).select("conv_id", "call_id", "c.turn", "c.valid", "c.refs"), "calls")
    results = rows.where(F.col("answers").isNotNull()).select("conv_id", F.col("answers").alias("call_id")).distinct()
    both = materialize(calls.join(results.withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False))), "linked-calls")
    levels = both.where(F.size("refs") == 0).select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    needs = both.where(F.size("refs") > 0).select("conv_id", "call_id", F.explode("refs").alias("ref"))
    if not needs.isEmpty():
        # One pass for each step of the longest chain; calls in a cycle never become ready, which ends it.
        while True:
            levels = materialize(levels, "levels")
            known = levels.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below"))
            ready = needs.join(levels, ["conv_id", "call_id"], "left_anti").join(known, ["conv_id", "ref"], "left").groupBy("conv_id", "call_id")
            ready = ready.agg(F.count_if(F.col("below").isNull()).alias("open"), (F.max("below") + 2).alias("level")).where("open = 0").select("conv_id", "call_id", "level")
            ready = materialize(ready, "ready")
            if ready.isEmpty():
                break
            levels = levels.union(ready)
    placed = materialize(both.join(levels, ["conv_id", "call_id"], "left"), "placed")
    of_call = placed.groupBy("conv_id", "turn").agg(F.count_if("answered").alias("linked"), F.max("level").alias("call_level"), F.count_if(F.col("level").isNull()).alias("cyclic"))
    answered = placed.select("conv_id", F.col("call_id").alias("answers"), (F.col("level") + 1).alias("result_level"), F.lit(True).alias("known"))
    out = rows.join(of_call, ["conv_id", "turn"], "left").join(answered, ["conv_id", "answers"], "left")
    has_calls = F.size("calls") > 0
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.size("calls").cast("long").alias("n_calls"),
        F.size(F.filter("calls", lambda c: ~c["valid"])).cast("long").alias("n_invalid"),
        F.when(has_calls, F.coalesce("linked", F.lit(0))).when(F.col("answers").isNotNull(), F.coalesce("known", F.lit(False)).cast("long")).otherwise(0).cast("long").alias("n_linked"),
        F.when(has_calls, F.when(F.coalesce("cyclic", F.lit(0)) == 0, F.coalesce("call_level", F.lit(0)))).when(F.col("answers").isNotNull(), F.coalesce("result_level", F.lit(0))).otherwise(0).cast("long").alias("level"),
        "line",
    )
