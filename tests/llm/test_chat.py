import json

import pytest

from mastwire.llm import chat
from mastwire.llm.store import table

SCHEMA = {"add": {"type": "object", "required": ["a"], "additionalProperties": False,
                  "properties": {"a": {"type": ["integer", "string"]}, "b": {"type": "array", "items": {"type": "number", "maximum": 5}},
                                 "c": {"enum": ["x", None]}, "d": {"type": "string", "pattern": "^q", "maxLength": 3}}}}


def call(i, arguments, name="add"):
    return {"id": i, "name": name, "arguments": arguments}


@pytest.mark.parametrize("value, wrong", [
    ({"a": 1}, 0), ({"a": 1.0}, 0), ({"a": True}, 1), ({"a": 1.5}, 1), ({}, 1), ({"a": "s", "z": 1}, 1), ({"a": 1, "b": [1, 9, "k"]}, 2),
    ({"a": 1, "c": None}, 0), ({"a": 1, "c": "y"}, 1), ({"a": 1, "d": "zzzz"}, 2), ([], 1)])
def test_schema(value, wrong):
    assert len(chat.faults(value, SCHEMA["add"])) == wrong


def test_waiting_order():
    assert chat.waiting_order(["a", "b", "c", "d"], [{"c"}, {"a"}, {"zz"}, set()]) == [2, 3, 0, 1]
    assert chat.waiting_order(["a", "b", "c"], [{"b"}, {"a"}, set()]) == [None, None, 0]


def test_links_order_and_faults(spark):
    rows = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "assistant", None, json.dumps([call("a", {"a": "${b}"}), call("b", '{"a": 2}'), call("c", {"a": "${no}"})]), None),
        (1, 2, "tool", "rb", None, "b"), (1, 3, "tool", "ra", None, "a"), (1, 4, "tool", "rb again", None, "b"), (1, 5, "tool", "?", None, "zz"),
        (1, 6, "assistant", "done", "[not json", None),
        (None, 1, "assistant", "x", json.dumps([call("a", {"a": 1})]), None), (None, 2, "tool", "y", None, "a"),
        (2, None, "assistant", "é", json.dumps([call("a", {"q": 1}, "none")]), None), (2, 3, "tool", None, None, "a"), (2, 1, None, "r", None, None),
    ]
    schema = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string"
    got = chat.linked(spark.createDataFrame(rows, schema), SCHEMA).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.part, r.status): r for r in got}
    said = by[1, 1, 0, None]
    assert [c["id"] for c in json.loads(said.json)["tool_calls"]] == ["b", "c", "a"]
    assert (said.n_calls, said.n_valid, said.n_answered, said.faults) == (3, 2, 2, "c: waits for unknown no")
    assert said.json == chat.canonical(json.loads(said.json))
    assert by[1, 1, 1, "linked"].json == '{"content":"rb","role":"tool","tool_call_id":"b"}' and by[1, 1, 3, "linked"].json
    assert by[1, 1, 1, "repeated"] and by[1, 5, 0, "orphan"] and by[1, 6, 0, None].faults.startswith("malformed")
    assert by[None, 2, 0, "orphan"] and by[None, 1, 0, None].n_answered == 0 and by[None, 1, 0, None].n_calls == 1
    assert by[2, None, 0, None].faults == "a: unknown tool" and '"é"' in by[2, None, 0, None].json
    assert chat.linked(spark.createDataFrame([], schema), SCHEMA).count() == 0


def test_given_conversations_against_plain_python(spark):
    given = table(spark, "/root/testdata/sf0.001", "conversations")
    messages = chat.from_conversations(given)
    got = {(r.conv_id, r.turn): r for r in chat.linked(messages, chat.TOOLS).where("part = 0").collect()}
    rows = messages.collect()
    answers = {r.tool_call_id for r in rows if r.role == "tool"}
    for r in rows:
        if r.role == "tool":
            continue
        calls = json.loads(r.tool_calls or "[]")
        out = got[r.conv_id, r.turn]
        assert out.n_calls == len(calls) and out.n_answered == sum(c["id"] in answers for c in calls)
        assert out.n_valid == sum(not chat.faults(c["arguments"], chat.TOOLS[c["name"]]) for c in calls)
        want = {"role": r.role, "content": r.text or ""}
        if calls:
            want["tool_calls"] = calls[::-1]  # each waits for the one after it
        assert out.json == chat.canonical(want)
    assert sum(1 for r in got.values()) == given.count()


def test_an_unreadable_call_keeps_its_siblings(spark):
    calls = json.dumps([call("a", {"a": 1}), call("b", "{bad"), {"name": "add", "arguments": {"a": 1}}, call("n", {"a": float("nan")}), 5])
    rows = [(1, 1, "assistant", None, calls, None), (1, 2, "tool", "ra", None, "a"), (1, 3, "tool", "rb", None, "b")]
    schema = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string"
    got = chat.linked(spark.createDataFrame(rows, schema), SCHEMA).collect()
    said = next(r for r in got if r.role == "assistant")
    assert (said.n_calls, said.n_valid, said.n_answered) == (5, 1, 2)
    assert [c["id"] for c in json.loads(said.json)["tool_calls"]] == ["a", "b", None, "n", None]
    assert sorted(r.status for r in got if r.role == "tool") == ["linked", "linked"]
    assert "b: malformed" in said.faults and "n: malformed" in said.faults and "?: malformed" in said.faults


def test_repeated_messages_count_once_and_other_messages_of_a_turn_apart(spark):
    import json

    from mastwire.llm import chat

    schema = {"t": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    call = lambda i, x: json.dumps([{"id": i, "name": "t", "arguments": {"x": x}}])
    long = "word " * 400_000
    rows = [(1, 1, "assistant", "hi", call("a", 1), None)] * 2 + [(1, 1, "assistant", long, call("b", "no"), None), (1, 2, "tool", "5", None, "a")]
    rows += [(1, 2, "tool", "5", None, "a")] + [(9, t, "assistant", "", call(f"k{t}", t), None) for t in range(500)]
    names = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], names + ", message long, fault string")
    got = chat.linked(df, schema).collect()
    assert len(got) == len(rows)
    said = [(r.n_calls, r.n_valid, r.n_answered, r.faults) for r in got if r.conv_id == 1 and r.role == "assistant"]
    assert sorted(said, key=str) == [(1, 0, 0, "b: $.x: not integer"), (1, 1, 1, None), (1, 1, 1, None)]
    assert [r.status for r in got if r.role == "tool"] == ["linked", "linked"]
    assert all((r.n_calls, r.n_valid) == (1, 1) for r in got if r.conv_id == 9)
