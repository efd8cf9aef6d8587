"""Tool calls in chats: linked to their results, ordered by what they wait for, checked, in canonical JSON.

A message's calls are parsed, checked against their tool's schema and put in an order in which
each follows the calls that its arguments name, all within the message's own row. Calls and
results then meet in a hash join on conversation and identifier, so a very long conversation is
spread over all tasks; no step gathers a conversation.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.llm.store import saved

#: ``${id}`` in an argument stands for the result of the call with that identifier.
REFERENCE = re.compile(r"\$\{([^{}]+)\}")
UNREADABLE = (ValueError, TypeError, KeyError, AttributeError, RecursionError, OverflowError)
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, and signs as they are; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks its schema: type, enum, bounds, lengths, pattern, properties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: does not match the pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    return found


def waiting_order(ids: list[str], needs: list[set[str]]) -> list[int | None]:
    """Place of each call after those it needs among ``ids``, earlier ones first; None for calls in a circle."""
    place: list[int | None] = [None] * len(ids)
    first = {name: i for i, name in reversed(list(enumerate(ids)))}
    waits = [{first[n] for n in need if n in first} for need in needs]
    after: dict[int, list[int]] = {}
    for i, own in enumerate(waits):
        for j in own:
            after.setdefault(j, []).append(i)
    left = [len(x) for x in waits]
    ready = [i for i, n in enumerate(left) if n == 0]
    done = 0
    while ready:
        # Calls that became free together keep their order in the message.
        free = []
        for i in ready:
            place[i] = done
            done += 1
            for j in after.get(i, ()):
                left[j] -= 1
                if not left[j]:
                    free.append(j)
        ready = sorted(free)
    return place


def _call(call: Any, schemas: dict[str, dict]) -> dict:
    """One call; of one that cannot be read, its fault and what can be read of it, its arguments as text."""
    try:
        if call["id"] is None or call["name"] is None:
            raise KeyError("id or name")
        arguments = call["arguments"]
        arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
        text = canonical(arguments)
        schema = schemas.get(call["name"])
        wrong = ["unknown tool"] if schema is None else faults(arguments, schema)
        return {"id": str(call["id"]), "name": str(call["name"]), "arguments": arguments, "faults": wrong,
                "needs": sorted(set(REFERENCE.findall(text)))}
    except UNREADABLE as error:
        own = call if isinstance(call, dict) else {"arguments": call}
        read = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
        return {"id": read(own.get("id")), "name": read(own.get("name")), "arguments": read(own.get("arguments")),
                "faults": [f"malformed: {type(error).__name__}"], "needs": []}


def _calls(raw: str | None, schemas: dict[str, dict]) -> tuple[list[dict], str | None]:
    """The calls of one message in waiting order, and what is wrong with the list as a whole."""
    if raw is None:
        return [], None
    try:
        calls = json.loads(raw)
        if not isinstance(calls, list):
            raise TypeError("not a list")
    except UNREADABLE as error:
        return [], f"malformed: {type(error).__name__}"
    parsed = [_call(call, schemas) for call in calls]
    places = waiting_order([c["id"] for c in parsed], [set(c["needs"]) for c in parsed])
    for call, place in zip(parsed, places, strict=True):
        call["place"] = place
        if place is None:
            call["faults"] = [*call["faults"], "waits for itself"]
    parsed.sort(key=lambda c: (c["place"] is None, c["place"] or 0))
    for i, call in enumerate(parsed):
        call["place"] = i
    return parsed, None


def _read(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message with its canonical JSON and its calls."""

    def run(batches):
        for batch in filter(len, batches):
            lines, calls, wrong = [], [], []
            for role, text, raw, call_id in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                own, fault = _calls(raw, schemas) if role == "assistant" else ([], None)
                line: dict[str, Any] = {"role": role, "content": text or ""}
                if own:
                    line["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": c["arguments"]} for c in own]
                if role == "tool":
                    line["tool_call_id"] = call_id
                lines.append(canonical(line))
                calls.append([{"call_id": c["id"], "place": c["place"], "faults": c["faults"], "needs": c["needs"]} for c in own])
                wrong.append(fault)
            kind = pa.list_(pa.struct([("call_id", pa.string()), ("place", pa.int32()), ("faults", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(5), pa.array(lines), pa.array(calls, kind), pa.array(wrong, pa.string())],
                names=["conv_id", "turn", "role", "tool_call_id", "json", "calls", "fault"])

    return messages.select("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id").mapInArrow(
        run, "conv_id long, turn long, role string, tool_call_id string, json string, "
             "calls array<struct<call_id string, place int, faults array<string>, needs array<string>>>, fault string")


def linked(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message: conv_id, turn, part, role, json, and how its calls or its result stand.

    ``messages`` has conv_id, turn, role, text, tool_calls (a JSON list of id, name and arguments,
    or null) and tool_call_id. ``schemas`` gives each tool's argument schema. In the result,
    (turn, part) orders a conversation: a tool result stands with the message that called it,
    part 1 and up in waiting order, any other message in its own turn as part 0.

    n_calls, n_valid and n_answered count a message's calls; ``status`` of a result is linked,
    repeated (a later result of the same call) or orphan; ``faults`` lists what is wrong. A null
    conv_id or identifier links with nothing; null text is empty content; a list that cannot be
    read is a fault and holds no calls; a call that cannot be read is a call with a fault. Of several calls with one identifier the first by turn is
    the owner. A message is known by its turn and its content: repeated rows are one message, whose calls
    count once, and each of them gets the same result row; two messages of one turn are judged apart.
    Messages of any length are taken whole, and columns of other names are not read.
    """
    read = saved(_read(messages, schemas).withColumn("message", F.xxhash64("turn", "role", "json", F.to_json("calls"))))
    calls = saved(read.select("conv_id", "turn", "message", F.explode("calls").alias("call")).select("conv_id", "turn", "message", "call.*").distinct())
    owner = saved(calls.where(F.col("conv_id").isNotNull()).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "place", "message")).alias("own"), F.count("*").alias("named")))
    results = read.where("role = 'tool'").select("conv_id", F.col("tool_call_id").alias("call_id"), "turn", "role", "json")
    firsts = saved(results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "json")).alias("first")))
    by = ["conv_id", "call_id"]
    # A result stands where its call stands.
    placed = results.join(owner, by, "left").join(firsts, by, "left").select(
        "conv_id", F.coalesce("own.turn", "turn").alias("turn"),
        F.when(F.col("own").isNotNull(), F.col("own.place") + 1).otherwise(0).alias("part"), "role", "json",
        F.when(F.col("own").isNull(), "orphan").when(F.struct("turn", "json") == F.col("first"), "linked").otherwise("repeated").alias("status"),
        F.when(F.col("own.turn") > F.col("turn"), "answered before it was called").alias("late"))
    answered = firsts.select(*by, F.lit(True).alias("answered"), F.col("first.turn").alias("answer_turn"))
    judged = calls.join(owner, by, "left").join(answered, by, "left")
    # What a call waits for must be a call of the conversation, in no later message.
    needs = calls.select("conv_id", "turn", "message", "place", F.explode("needs").alias("need")).join(
        owner.select("conv_id", F.col("call_id").alias("need"), F.col("own.turn").alias("need_turn")), ["conv_id", "need"], "left")
    unmet = needs.where(F.col("need_turn").isNull() | (F.col("need_turn") > F.col("turn"))).groupBy("conv_id", "message", "place").agg(
        F.array_sort(F.collect_set("need")).alias("unmet"))
    unmet = saved(unmet)
    same = (judged["conv_id"].eqNullSafe(unmet["conv_id"])) & (judged["message"] == unmet["message"]) & (judged["place"] == unmet["place"])
    judged = judged.join(unmet, same, "left").select(
        judged["conv_id"], judged["message"], judged["call_id"], F.coalesce("answered", F.lit(False)).alias("answered"),
        F.concat("faults", F.when(F.col("named") > 1, F.array(F.lit("identifier used again"))).otherwise(F.array().cast("array<string>")),
                 F.transform(F.coalesce("unmet", F.array().cast("array<string>")), lambda x: F.concat(F.lit("waits for unknown "), x))).alias("faults"))
    counts = saved(judged.groupBy("conv_id", "message").agg(
        F.count("*").alias("n_calls"), F.sum((F.size("faults") == 0).cast("long")).alias("n_valid"), F.sum(F.col("answered").cast("long")).alias("n_answered"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.size("faults") > 0, F.concat_ws("; ", F.concat(F.coalesce("call_id", F.lit("?")), F.lit(": "), F.array_join("faults", ", ")))))), " | ").alias("faults")))
    own = read.where("role is null or role <> 'tool'")
    said = own.join(counts, own["conv_id"].eqNullSafe(counts["conv_id"]) & (own["message"] == counts["message"]) & (F.size(own["calls"]) > 0), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    text = lambda *c: F.nullif(F.concat_ws(" | ", *c), F.lit("")).alias("faults")
    return said.select(
        own["conv_id"], own["turn"], F.lit(0).alias("part"), "role", "json", zero("n_calls"), zero("n_valid"), zero("n_answered"),
        F.lit(None).cast("string").alias("status"), text(F.col("fault"), F.nullif(F.col("faults"), F.lit("")))
    ).unionByName(placed.select(
        "conv_id", "turn", "part", "role", "json", *(F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_valid", "n_answered")),
        "status", text(F.col("late"))))


#: Tools of the calls that ``from_conversations`` derives.
TOOLS = {
    "measure": {"type": "object", "required": ["text", "words"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 60}, "after": {"type": "string"}}},
    "shorten": {"type": "object", "required": ["text", "limit"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 20}, "limit": {"type": "number", "minimum": 1}, "after": {"type": "string"}}},
}


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Chats with tool calls, from chats without: every line of an assistant's turn asks for a measure or a shortening.

    A line's call waits for the call of the line after it, so the order must be found; every
    seventh line (by hash) gets no answer. Answers are messages of their own, in the same turn.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 0)
    name = lambda i: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), i.cast("string"))
    words = lambda x: F.size(F.split(F.trim(x), " +"))
    after = lambda i: F.when(i + 1 < F.size("lines"), F.concat(F.lit("${"), name(i + 1), F.lit("}")))
    base = conversations.select("conv_id", "turn", "role", "text", lines.alias("lines"))
    calls = F.transform("lines", lambda x, i: F.struct(
        name(i).alias("id"), F.when(words(x) % 2 == 0, "measure").otherwise("shorten").alias("name"),
        F.struct(x.alias("text"), F.when(words(x) % 2 == 0, words(x)).alias("words"), F.when(words(x) % 2 == 1, F.length(x) / 2).alias("limit"),
                 after(i).alias("after")).alias("arguments")))
    asks = (F.col("role") == "assistant") & (F.size("lines") > 0)
    nothing = F.lit(None).cast("string")
    said = base.select("conv_id", "turn", "role", "text", F.when(asks, F.to_json(calls)).alias("tool_calls"), nothing.alias("tool_call_id"))
    answers = base.where(asks).select("conv_id", "turn", F.posexplode("lines").alias("i", "line")).where(F.crc32("line") % 7 != 0).select(
        "conv_id", "turn", F.lit("tool").alias("role"), F.concat(F.lit("length "), F.length("line").cast("string")).alias("text"),
        nothing.alias("tool_calls"), name(F.col("i")).alias("tool_call_id"))
    return said.unionByName(answers)
