"""Chat formatting with tool-call linking.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object with ``tool_calls`` (id, name,
arguments: an object or its JSON string) and ``content``; a tool's text one with ``tool_call_id`` and ``content``; any
other text is plain content. Calls and results meet in a hash join on (conv_id, id): only the ids move, and only of
messages that have any. A result must come after its call, so its place is the later of the two turns: sorting by (conv_id,
order_turn, order_step, turn, message) is a topological order, total but for equal messages, and no conversation is ever
gathered into one task. Arguments are checked and serialised in their own row; the checks of a schema, nested ones too, are
one SQL expression.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import stored

#: JSON schema types by the SQL type that a value's variant has.
_KINDS = "case when k = 'VOID' then 'null' when k like 'OBJECT%' then 'object' when k like 'ARRAY%' then 'array' when k = 'STRING' then 'string' when k = 'BOOLEAN' then 'boolean' when k = 'BIGINT' then 'integer' else 'number' end"
#: Problems of arguments; of several the first in this order is reported.
PROBLEMS = ["missing_argument", "unknown_argument", "wrong_type", "not_in_enum", "out_of_bounds", "no_match"]
_BOUNDS = {"minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"}
_KEYWORDS = {"type", "properties", "required", "additionalProperties", "enum", "items", "pattern", "title", "description", "default", "examples"} | _BOUNDS


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _checks(v: str, schema: dict, depth: int = 0) -> str:
    """SQL for the problems (array<string>) of variant ``v`` under a JSON schema; keywords that aren't known raise."""
    if unknown := set(schema) - _KEYWORDS:
        raise ValueError(f"schema keywords that are not supported: {sorted(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    m, k, x = f"m{depth}", f"k{depth}", f"x{depth}"
    found: list[str] = []

    def test(condition: str, problem: str) -> None:
        found.append(f"if({condition}, array('{problem}'), array())")

    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds:
        fits = sorted({f for t in kinds for f in {"number": ["number", "integer"]}.get(t, [t])})
        test(f"{k} not in ({', '.join(map(_quoted, fits))})", "wrong_type")
    if "enum" in schema:
        choices = [json.dumps(c, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for c in schema["enum"]]
        test(f"not array_contains(array({', '.join(map(_quoted, choices))}), to_json({v}))", "not_in_enum")
    for kind, size, low, high in (("('integer', 'number')", f"try_variant_get({v}, '$', 'double')", "minimum", "maximum"), ("('string')", f"length(try_variant_get({v}, '$', 'string'))", "minLength", "maxLength"), ("('array')", f"size(try_variant_get({v}, '$', 'array<variant>'))", "minItems", "maxItems")):
        for bound, sign in ((low, "<"), (high, ">")):
            if bound in schema:
                test(f"{k} in {kind} and {size} {sign} {float(schema[bound])}D", "out_of_bounds")
    if "pattern" in schema:
        test(f"{k} = 'string' and not try_variant_get({v}, '$', 'string') rlike {_quoted(schema['pattern'])}", "no_match")
    for name in schema.get("required", []):
        test(f"{k} = 'object' and not map_contains_key({m}, {_quoted(name)})", "missing_argument")
    properties = schema.get("properties", {})
    if schema.get("additionalProperties", True) is False:
        names = f"array({', '.join(map(_quoted, sorted(properties)))})" if properties else "cast(array() as array<string>)"
        test(f"size(array_except(map_keys({m}), {names})) > 0", "unknown_argument")
    for name, rule in sorted(properties.items()):
        found.append(f"if(map_contains_key({m}, {_quoted(name)}), {_checks(f'{m}[{_quoted(name)}]', rule, depth + 1)}, array())")
    if "items" in schema:
        found.append(f"coalesce(flatten(transform(try_variant_get({v}, '$', 'array<variant>'), {x} -> {_checks(x, schema['items'], depth + 1)})), array())")
    body = f"concat(cast(array() as array<string>), {', '.join(found)})" if found else "cast(array() as array<string>)"
    kind = f"transform(array(schema_of_variant({v})), k -> {_KINDS})"
    fields = f"array(coalesce(try_variant_get({v}, '$', 'map<string,variant>'), map()))"
    return f"transform({kind}, {k} -> transform({fields}, {m} -> {body})[0])[0]"


def _problem(schemas: dict[str, dict]) -> str:
    """SQL for the problem of a call ``c`` (id, name, args, object), or null."""
    cases = "".join(f" when c.name = {_quoted(name)} then {_checks('c.args', schema)}" for name, schema in sorted(schemas.items()))
    first = f"get(filter(array({', '.join(map(_quoted, PROBLEMS))}), p -> array_contains(case{cases} end, p)), 0)" if schemas else "null"
    unknown = f"when c.name not in ({', '.join(map(_quoted, sorted(schemas)))}) then 'unknown_tool'" if schemas else ""
    return f"case when c.id is null then 'no_id' when c.name is null then 'no_name' when c.args is null then 'bad_json' when not coalesce(c.object, false) then 'not_an_object' {unknown} else {first} end"


def format_messages(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """A row per message: conv_id, turn, role, order_turn, order_step, message (canonical JSON) and status.

    Canonical JSON has sorted keys, no spaces and no null members. ``schemas`` maps tools to JSON schemas (type, properties,
    required, additionalProperties, enum, items, pattern and bounds, nested as deep as they go; other keywords raise);
    without it only the form of arguments is checked. ``status`` is ``ok``; for calls the first call's problem (no_id,
    no_name, bad_json, not_an_object, unknown_tool, one of PROBLEMS, repeated_id, unanswered); for results ``orphan_result``,
    ``early_result`` or ``repeated_result``. Of calls that repeat an id in a conversation the one with the smallest turn
    counts; its answer is the first result at or after it, or, if there is none, the first one before it, which then moves
    behind the call. Rows repeated at that turn count alike. order_turn is the turn, or for a result of a later call that
    call's; order_step is 1 for results, else 0. White space before a JSON object doesn't matter. A null conv_id or turn
    links nothing, a null text is a message without content. Other columns are left out; an empty table stays empty.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    may = F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^[ \t\r\n]*\{")
    rows = rows.withColumn("v", F.when(may, F.try_parse_json("text")))
    calls = F.when(F.col("role") == "assistant", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"))
    rows = rows.withColumn("raw_calls", calls).withColumn("answers", F.when(F.col("role") == "tool", F.expr("try_variant_get(v, '$.tool_call_id', 'string')")))
    one = F.expr(
        """transform(raw_calls, r -> named_struct('id', try_variant_get(r, '$.id', 'string'), 'name', try_variant_get(r, '$.name', 'string'),
          'args', coalesce(if(schema_of_variant(variant_get(r, '$.arguments')) = 'STRING', try_parse_json(try_variant_get(r, '$.arguments', 'string')), variant_get(r, '$.arguments')), if(variant_get(r, '$.arguments') is null, parse_json('{}'), null))))"""
    )
    checked = f"transform(transform(calls, c -> named_struct('id', c.id, 'name', c.name, 'args', c.args, 'object', schema_of_variant(c.args) like 'OBJECT%')), c -> {_problem(schemas or {})})"
    rows = rows.withColumn("calls", one).withColumn("problem", F.expr(f"get(filter({checked}, p -> p is not null), 0)"))

    asked = rows.where("size(calls) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("calls.id").alias("id")).where("id is not null")
    given = rows.where("answers is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.col("answers").alias("id"))
    # Stored before they are joined back: both sides are then plain shuffles, which AQE splits where an id is hot.
    first_call = stored(asked.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn")), "calls")
    after = F.min(F.when(F.col("turn") >= F.col("call_turn"), F.col("turn")))
    # Stored once more before it is grouped: an aggregate by the join's own keys would keep AQE from splitting a hot id.
    given = stored(given.join(first_call, ["conv_id", "id"]), "answers")
    answer = given.groupBy("conv_id", "id").agg(F.coalesce(after, F.min("turn")).alias("result_turn"))
    links = stored(first_call.join(answer, ["conv_id", "id"], "left"), "links")

    content = F.when(F.col("raw_calls").isNotNull() | F.col("answers").isNotNull(), F.expr("coalesce(try_variant_get(v, '$.content', 'string'), nullif(to_json(variant_get(v, '$.content')), 'null'))")).otherwise(F.col("text"))
    listed = F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.struct(c["args"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))))
    rows = rows.withColumn("message", F.to_json(F.struct(content.alias("content"), "role", F.col("answers").alias("tool_call_id"), listed.alias("tool_calls"))))

    def out(df: DataFrame, turn: Column, step: int, status: Column) -> DataFrame:
        return df.select("conv_id", "turn", "role", turn.alias("order_turn"), F.lit(step).alias("order_step"), "message", status.alias("status"))

    plain = rows.where("coalesce(size(calls), 0) <= 0 and answers is null")
    plain = out(plain, F.col("turn"), 0, F.lit("ok"))
    results = rows.where("answers is not null").withColumnRenamed("answers", "id").join(links, ["conv_id", "id"], "left")
    state = F.when(F.col("call_turn").isNull(), "orphan_result").when(F.col("turn") == F.col("result_turn"), "ok")
    state = state.when(F.col("turn") < F.col("call_turn"), "early_result").otherwise("repeated_result")
    results = out(results, F.greatest("turn", F.coalesce("call_turn", "turn")), 1, state)
    # What a message's calls lack comes back by the message's own values, one row for each.
    key = F.xxhash64("conv_id", "turn", "text")
    callers = rows.where("size(calls) > 0").withColumn("key", key)
    state = F.when(F.col("turn") > F.col("call_turn"), 1).when(F.col("result_turn").isNull(), 2)
    lacks = callers.select("conv_id", "turn", "key", F.explode("calls.id").alias("id")).distinct().join(links, ["conv_id", "id"]).groupBy("conv_id", "turn", "key").agg(F.min(state).alias("lack"))
    lacks = lacks.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("key").alias("k2"), "lack")
    same = (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")) & (F.col("key") == F.col("k2"))
    status = F.coalesce("problem", F.when(F.col("lack") == 1, "repeated_id").when(F.col("lack") == 2, "unanswered"), F.lit("ok"))
    asking = out(callers.join(lacks, same, "left"), F.col("turn"), 0, status)
    return plain.unionByName(results).unionByName(asking)


#: Schemas of the registered query.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "get_document": {"properties": {"document_id": {"type": "string"}, "spans": {"type": "array", "items": {"type": "object", "properties": {"start": {"type": "integer", "minimum": 0}}, "required": ["start"]}}}, "required": ["document_id"]},
}


def as_tool_calls(messages: DataFrame) -> DataFrame:
    """``messages`` with tool calls in conversations of even id, which the given table has none of, by fixed rules on conv_id
    and turn (k is their sum): an assistant's message calls a tool (k % 3 says which) about its own text, with an argument
    missing, unknown, out of bounds or of a wrong type for some k, and a user's message after the first turn becomes the
    result of the call a turn earlier, or of none for some k. All messages and texts are kept."""
    k, text = F.col("conv_id") + F.col("turn"), F.col("text")
    search = F.when(k % 5 == 0, F.to_json(F.struct(k.alias("top_k")))).when(k % 7 == 0, F.to_json(F.struct(text.alias("query"), k.alias("limit")))).otherwise(F.to_json(F.struct(text.alias("query"), (k % 120).alias("top_k"))))
    span = F.array(F.struct((k - F.col("conv_id") - 2).alias("start")))
    read = F.when(k % 7 == 0, F.to_json(F.struct(k.alias("document_id")))).otherwise(F.to_json(F.struct(text.alias("document_id"), span.alias("spans"))))
    name = F.when(k % 3 == 0, "search").when(k % 3 == 1, "get_document").otherwise("lookup")
    asked = F.struct(F.concat(F.lit("call-"), F.col("turn")).alias("id"), name.alias("name"), F.when(k % 3 == 0, search).otherwise(read).alias("arguments"))
    call = F.to_json(F.struct(text.alias("content"), F.array(asked).alias("tool_calls")))
    answers = F.when(k % 11 == 0, "call-none").otherwise(F.concat(F.lit("call-"), F.col("turn") - 1))
    result = F.concat(F.lit(" "), F.to_json(F.struct(answers.alias("tool_call_id"), text.alias("content"))))
    even = F.col("conv_id") % 2 == 0
    asks, gives = even & (F.col("role") == "assistant"), even & (F.col("role") == "user") & (F.col("turn") > 0)
    return messages.select("conv_id", "turn", F.when(gives, "tool").otherwise(F.col("role")).alias("role"), F.when(asks, call).when(gives, result).otherwise(text).alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_messages(as_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)


_ARGUMENTS = """case when k % 3 = 0 and k % 5 = 0 then '{"top_k":' || k || '}' when k % 3 = 0 and k % 7 = 0 then '{"limit":' || k || ',"query":' || t || '}'
    when k % 3 = 0 then '{"query":' || t || ',"top_k":' || k % 120 || '}' when k % 7 = 0 then '{"document_id":' || k || '}' else '{"document_id":' || t || ',"spans":[{"start":' || turn - 2 || '}]}' end"""

#: Turns identify a message of a conversation in the given tables, and texts aren't null.
SQL = {
    "op9_chat": f"""
with m as (select *, conv_id + turn as k, cast(to_json(text) as varchar) as t, conv_id % 2 = 0 and role = 'assistant' as asks, conv_id % 2 = 0 and role = 'user' and turn > 0 as gives from conversations),
calls as (select *, 'call-' || turn as id, case k % 3 when 0 then 'search' when 1 then 'get_document' else 'lookup' end as name, {_ARGUMENTS} as args,
  case when k % 3 = 2 then 'unknown_tool' when k % 3 = 0 and k % 5 = 0 then 'missing_argument' when k % 3 = 0 and k % 7 = 0 then 'unknown_argument'
    when k % 3 = 0 and k % 120 not between 1 and 100 then 'out_of_bounds' when k % 3 = 1 and k % 7 = 0 then 'wrong_type' when k % 3 = 1 and turn < 2 then 'out_of_bounds' end as problem
  from m where asks),
results as (select *, case when k % 11 = 0 then 'call-none' else 'call-' || (turn - 1) end as id from m where gives),
answered as (select conv_id, id, min(r.turn) as turn from results r join calls c using (conv_id, id) where r.turn >= c.turn group by all)
select conv_id, turn, role, turn as order_turn, 0 as order_step, case when text is null then '{{"role":"' || role || '"}}' else '{{"content":' || t || ',"role":"' || role || '"}}' end as message, 'ok' as status
from m where not asks and not gives
union all select c.conv_id, c.turn, role, c.turn, 0, '{{"content":' || t || ',"role":"assistant","tool_calls":[{{"arguments":' || args || ',"id":"' || c.id || '","name":"' || name || '"}}]}}',
  coalesce(problem, case when a.id is null then 'unanswered' else 'ok' end) from calls c left join answered a on a.conv_id = c.conv_id and a.id = c.id
union all select r.conv_id, r.turn, 'tool', r.turn, 1, '{{"content":' || r.t || ',"role":"tool","tool_call_id":"' || r.id || '"}}', case when c.id is null then 'orphan_result' when a.turn = r.turn then 'ok' else 'repeated_result' end
from results r left join calls c on c.conv_id = r.conv_id and c.id = r.id left join answered a on a.conv_id = r.conv_id and a.id = r.id
"""
}
