import json

import pytest

from lodestone.llm.chat import SCHEMAS, format_messages


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="done"):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, schemas=SCHEMAS, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + more)
    return {(r.conv_id, r.turn, r.role): r for r in format_messages(df, schemas).collect()}


def test_links_order_and_canonical_json(spark):
    got = run(spark, [
        (1, 0, "user", 'a "q"\n'),
        (1, 1, "tool", result("x")),
        (1, 2, "assistant", call(("x", "search", {"top_k": 3, "query": "é"}))),
        (1, 3, "assistant", call(("y", "search", '{"query": "z"}'), content="hm")),
        (1, 4, "tool", result("y")),
        (1, 5, "tool", result("y")),
        (1, 6, "tool", result("nope")),
        (2, 0, "tool", result("x")),
    ])
    assert got[1, 0, "user"].message == '{"content":"a \\"q\\"\\n","role":"user"}'
    early = got[1, 1, "tool"]
    assert (early.order_turn, early.order_step, early.status) == (2, 1, "ok")
    assert got[1, 2, "assistant"].message == '{"role":"assistant","tool_calls":[{"arguments":{"query":"é","top_k":3},"id":"x","name":"search"}]}'
    assert got[1, 2, "assistant"].status == got[1, 3, "assistant"].status == got[1, 4, "tool"].status == "ok"
    assert json.loads(got[1, 3, "assistant"].message)["tool_calls"][0]["arguments"] == {"query": "z"}
    assert got[1, 5, "tool"].status == "repeated_result"
    assert got[1, 6, "tool"].status == got[2, 0, "tool"].status == "orphan_result"


def test_argument_checks(spark):
    cases = {
        "missing_argument": ("a", "search", {"top_k": 1}),
        "unknown_argument": ("a", "search", {"query": "q", "zz": 1}),
        "wrong_type": ("a", "search", {"query": 5}),
        "unknown_tool": ("a", "other", {}),
        "bad_json": ("a", "search", "{oops"),
        "not_an_object": ("a", "search", [1]),
        "no_id": (None, "search", {"query": "q"}),
        "unanswered": ("a", "get_document", {"document_id": "d", "more": 1}),
    }
    rows = [(i, 0, "assistant", call(c)) for i, c in enumerate(cases.values())]
    got = run(spark, rows)
    assert {k: got[i, 0, "assistant"].status for i, k in enumerate(cases)} == {k: k for k in cases}
    twice = run(spark, [(1, 0, "assistant", call(("a", "search", {"query": "q"}))), (1, 1, "assistant", call(("a", "search", {"query": "q"}))), (1, 2, "tool", result("a"))])
    assert [twice[1, t, "assistant"].status for t in (0, 1)] == ["ok", "repeated_id"]


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1), (1, None, "assistant", call(("a", "search", {"query": "q"})), 2), (1, 0, "user", "", 3), (1, 0, "user", "", 3), (1, 2, "tool", "{not json", 4), (1, 3, "assistant", '{"a": 1}', 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int")
    got = format_messages(df, SCHEMAS).collect()
    assert len(got) == 6
    assert {r.message for r in got if r.role is None} == {"{}"}
    assert {r.message for r in got if r.role == "tool"} == {'{"content":"{not json","role":"tool"}'}
    assert format_messages(df.limit(0)).count() == 0


def test_answer_is_the_first_result_after_the_call(spark):
    got = run(spark, [(1, 0, "tool", result("a")), (1, 1, "assistant", call(("a", "search", {"query": "q"}))), (1, 2, "tool", " \n" + result("a")), (1, 3, "tool", result("a")), (1, 3, "tool", result("a", "two"))])
    assert (got[1, 0, "tool"].status, got[1, 0, "tool"].order_turn, got[1, 0, "tool"].order_step) == ("early_result", 1, 1)
    assert [got[1, t, "tool"].status for t in (2, 3)] == ["ok", "repeated_result"]
    order = sorted(got.values(), key=lambda r: (r.order_turn, r.order_step, r.turn, r.message))
    assert [r.turn for r in order] == [1, 0, 2, 3]


def test_nested_schemas(spark):
    inner = {"type": "object", "properties": {"n": {"type": "integer", "maximum": 3}, "tag": {"enum": ["a", None]}}, "required": ["n"], "additionalProperties": False}
    schemas = {"t": {"properties": {"list": {"type": "array", "items": inner, "minItems": 1}, "o'k": {"type": "string", "pattern": "^x", "maxLength": 3}, "deep": {"properties": {"in": inner}}}}}
    cases = [
        ({"list": [{"n": 1}, {"n": 3, "tag": None}], "o'k": "xyz", "deep": {"in": {"n": -1}}}, "unanswered"),
        ({"list": []}, "out_of_bounds"), ({"list": [{"n": 4}]}, "out_of_bounds"), ({"list": [{"n": 1}, {}]}, "missing_argument"), ({"list": [{"n": "1"}]}, "wrong_type"),
        ({"list": [{"n": 1, "x": 2}]}, "unknown_argument"), ({"list": {}}, "wrong_type"), ({"o'k": "yx"}, "no_match"), ({"o'k": "xxxx"}, "out_of_bounds"), ({"deep": {"in": {"n": 1, "tag": "b"}}}, "not_in_enum"), ({"deep": 5}, "unanswered"),
    ]
    got = run(spark, [(i, 0, "assistant", call(("a", "t", a))) for i, (a, _) in enumerate(cases)], schemas)
    assert [got[i, 0, "assistant"].status for i in range(len(cases))] == [want for _, want in cases]
    with pytest.raises(ValueError):
        run(spark, [(1, 0, "user", "x")], {"t": {"oneOf": []}})
