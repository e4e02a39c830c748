"""Chat formatting with tool-call linking, DataFrame functions only.

An assistant message may be a JSON object with ``tool_calls`` (objects with
id, name and arguments) and ``content``; a message of the role ``tool`` may
be a JSON object with ``tool_call_id`` and ``content``. Calls and results of
a conversation are joined by identifier, results are ordered behind their
calls, arguments are checked against the tools' schemas, and every message
is written as canonical JSON: keys sorted, no white space, no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexframe.session import Scratch

MESSAGE = "content string, tool_call_id string, tool_calls array<struct<arguments: string, id: string, name: string>>"
#: Tools and the schemas of their arguments, as JSON Schema has them: type, properties, required, items, enum. Objects take no other properties than those named, if any are.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "filters": {"type": "array", "items": {"type": "string"}}}, "required": ["query"]},
    "get_weather": {"type": "object", "properties": {"city": {"type": "string"}, "unit": {"type": "string", "enum": ["celsius", "fahrenheit"]}}, "required": ["city"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "headers": {"type": "object"}, "retry": {"type": "object", "properties": {"times": {"type": "integer"}}, "required": ["times"]}}, "required": ["url"]},
}
#: What the engine calls the JSON types.
_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "integer": "^BIGINT$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def fits(v: Column, schema: dict) -> Column:
    """Whether a variant satisfies a schema; a missing one (null) doesn't."""
    good = F.lit(True)
    if "type" in schema:
        good &= F.schema_of_variant(v).rlike(_TYPES[schema["type"]])
    if "enum" in schema:
        good &= F.to_json(v).isin(*[_canonical(x) for x in schema["enum"]])
    if "items" in schema:
        good &= F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(fits(x, schema["items"]), F.lit(False)))
    if fields := schema.get("properties"):
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
        good &= F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0
        for field, own in fields.items():
            one = fits(F.try_variant_get(v, f"$['{field}']", "variant"), own)
            good &= one if field in schema.get("required", ()) else ~F.array_contains(keys, field) | one
    return F.coalesce(good, F.lit(False))


def _canonical(x) -> str:
    import json

    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def valid(name: Column, arguments: Column, tools=TOOLS) -> Column:
    """Whether the tool is known and its arguments, a JSON text, satisfy its schema."""
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, schema in tools.items():
        out = F.when(name == tool, fits(v, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def whole_object(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it, which the parsers alone would pass over.

    The text is put between a key and another field whose value, a digest of
    the text, it can't hold itself: only if the value ends where the text
    does is that field found, and no third one.
    """
    seal = F.sha2(text.cast("binary"), 256)
    wrapped = F.concat(F.lit('{"a":'), text, F.lit(',"z":"'), seal, F.lit('"}'))
    found = F.try_variant_get(F.try_parse_json(wrapped), "$.z", "string")
    return F.coalesce((found == seal) & (F.size(F.json_object_keys(wrapped)) == 2), F.lit(False))


def link(messages: DataFrame, tools=TOOLS) -> DataFrame:
    """One row per message (conv_id, turn, role, text): its place, its links and its canonical JSON.

    Returned: conv_id, turn, role, sort_turn and sort_step (conversations
    read in order of sort_turn, sort_step, turn have every result behind its
    call), n_calls, n_linked (calls that have a result; for a result 1 if its
    call is there), n_invalid (calls that fail their schema), json. Of calls
    with the same identifier in a conversation the earliest counts; calls of
    one message count each, with or without identifiers. Null text is empty
    content; a message that isn't wholly JSON of the above form is plain
    content. Null conv_id or identifier links nothing. Repeated messages each
    return, with the same links. Very long texts are read whole; an empty
    table stays empty. Other columns of ``messages`` are not kept.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    maybe = F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool")
    whole = F.when(maybe & whole_object(F.col("text")), F.from_json("text", MESSAGE))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    kinds = rows.withColumn("j", whole).withColumn("kind", F.when(is_call, 1).when(is_result, 2).otherwise(0))
    zero = F.lit(0).cast("long")

    def shaped(df, sort_turn, sort_step, n_calls, n_linked, n_invalid, json):
        return df.select("conv_id", "turn", "role", sort_turn.alias("sort_turn"), sort_step.cast("int").alias("sort_step"), n_calls.cast("long").alias("n_calls"), n_linked.cast("long").alias("n_linked"), n_invalid.cast("long").alias("n_invalid"), json.alias("json"))

    plain = shaped(kinds.where("kind = 0"), F.col("turn"), zero, zero, zero, zero, F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))))

    # Calls and results are read once and kept; a message's identity is its place and content, so repeated messages share their links.
    linked = Scratch(messages.sparkSession).write(kinds.where("kind > 0").withColumn("uid", F.sha2(F.col("text").cast("binary"), 256)).drop("text"), "linked")
    calls, results = linked.where("kind = 1"), linked.where("kind = 2").withColumn("id", F.col("j.tool_call_id"))
    each = calls.select("conv_id", "turn", "uid", F.posexplode("j.tool_calls").alias("at", "c")).select("conv_id", "turn", "uid", "at", F.col("c.id").alias("id"), (~valid(F.col("c.name"), F.col("c.arguments"), tools)).cast("int").alias("bad")).distinct()
    called, came = each.select("conv_id", "id", F.col("turn").alias("call_turn"), F.lit(0).alias("hit")), results.select("conv_id", "id", F.lit(None).cast("long").alias("call_turn"), F.lit(1).alias("hit"))
    # One row per identifier, summed on the map side: a call with very many results is one row here.
    met = called.unionByName(came).where("conv_id IS NOT NULL AND id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("call_turn").alias("call_turn"), F.max(1 - F.col("hit")).alias("is_called"), F.max("hit").alias("hit"))
    per_call = each.join(met.select("conv_id", "id", "hit"), ["conv_id", "id"], "left").groupBy("conv_id", "turn", "uid").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("linked"), F.sum("bad").alias("bad"))
    sorted_calls = F.transform("j.tool_calls", lambda c: F.struct(F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), F.to_json(F.struct(c["arguments"].alias("raw")))).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    one = F.transform(sorted_calls, lambda c: F.concat(F.lit('{"arguments":'), c["arguments"], F.when(c["id"].isNull() & c["name"].isNull(), F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(F.to_json(F.struct(c["id"].alias("id"), c["name"].alias("name"))), 2, 1 << 30)))))
    head = F.to_json(F.struct(F.coalesce("j.content", F.lit("")).alias("content"), F.col("role").alias("role")))
    call_json = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"tool_calls":['), F.array_join(one, ","), F.lit("]}"))
    per_call = per_call.withColumnsRenamed({c: f"of_{c}" for c in ("conv_id", "turn", "uid")})
    same = calls.conv_id.eqNullSafe(F.col("of_conv_id")) & calls.turn.eqNullSafe(F.col("of_turn")) & (calls.uid == F.col("of_uid"))
    with_calls = shaped(calls.join(per_call, same), F.col("turn"), zero, F.size("j.tool_calls"), F.col("linked"), F.col("bad"), call_json)

    found = results.join(met.where("is_called = 1").select("conv_id", "id", F.lit(1).alias("known"), "call_turn"), ["conv_id", "id"], "left")
    result_json = F.to_json(F.struct(F.coalesce("j.content", F.lit("")).alias("content"), F.col("role").alias("role"), F.col("id").alias("tool_call_id")))
    with_results = shaped(found, F.greatest("turn", "call_turn"), F.coalesce(F.col("turn") <= F.col("call_turn"), F.lit(False)), zero, F.col("known").isNotNull(), zero, result_json)
    return plain.unionByName(with_calls).unionByName(with_results)


#: Over messages that aren't JSON objects (the tool-call forms are tested on fixtures).
ORACLE = """
    SELECT conv_id, turn, role, turn AS sort_turn, 0::INTEGER AS sort_step, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
           CASE WHEN role IS NULL THEN json_object('content', coalesce(text, '')) ELSE json_object('content', coalesce(text, ''), 'role', role) END::VARCHAR AS json
    FROM conversations"""
