"""Tool-call linking in conversations, with DataFrame and SQL functions only.

An assistant message may hold calls, a tool message results, as JSON in its text:

    {"tool_calls": [{"id": "c1", "name": "search", "arguments": {"q": "..."}, "after": ["c0"]}], "content": "..."}
    {"tool_calls": [{"id": "c1", "function": {"name": "search", "arguments": "{\\"q\\": \\"...\\"}"}}]}
    {"tool_results": [{"call_id": "c1", "content": ...}]}      or      {"tool_call_id": "c1", "content": ...}

`after` names calls of the same conversation that must come first; an argument whose value is exactly "$c0" does the same
if the conversation has a call c0, and then fits every type.
Calls and results meet by (conversation, identifier) in hash joins. Every call gets its level, one more than the
highest of the calls that it waits for, by peeling: each round is one join, and the loop ends when a round adds
nothing; calls on a cycle keep no level. Arguments are validated against the tools' schemas. Every unit (message, call,
result) is serialised as canonical JSON: keys sorted, no white space, which is how the variant type writes objects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

_CALLS = "struct<tool_calls:array<variant>,content:variant>"
_RESULTS = "struct<tool_results:array<struct<call_id:string,content:variant>>,tool_call_id:string,content:variant>"

#: name -> parameter -> (type, required); types are those of JSON. A parameter type 'any' takes everything.
EXAMPLE_TOOLS = {"search": {"q": ("string", True), "limit": ("integer", False)}, "add": {"a": ("number", True), "b": ("number", True)}}


def canonical(json: Column) -> Column:
    """Sorted keys and no white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _type_ok(kind: str, value: Column, references: Column) -> Column:
    """Whether a variant has a JSON type. A reference to another call's result has any type."""
    got = F.schema_of_variant(value)
    number = got.rlike(r"^(BIGINT|DECIMAL\(|DOUBLE|FLOAT)")
    tests = {
        "string": got == "STRING",
        "boolean": got == "BOOLEAN",
        "number": number,
        "integer": (got == "BIGINT") | got.rlike(r"^DECIMAL\(\d+,0\)"),
        "array": got.startswith("ARRAY"),
        "object": got.startswith("OBJECT"),
        "null": got == "VOID",
        "any": F.lit(True),
    }
    reference = (got == "STRING") & F.array_contains(references, F.try_variant_get(value, "$", "string"))
    return F.coalesce(tests[kind] | reference, F.lit(False))


def problems(name: Column, arguments: Column, tools: dict, references: Column | None = None) -> Column:
    """array<string> of what is wrong with a call's arguments, in the order of the schema; empty if it is valid.
    references: the strings ("$" and a call's identifier) that stand for results."""
    references = F.array().cast("array<string>") if references is None else references
    known = F.lit(False)
    found = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    for tool, parameters in tools.items():
        here = name == tool
        known = known | here
        checks = [F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments: no object"))]
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(arguments, f"$['{p}']", "variant")
            there = F.array_contains(keys, p)
            checks.append(F.when(~there, F.lit(f"{p}: missing") if required else F.lit(None)).when(~_type_ok(kind, value, references), F.lit(f"{p}: no {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))), lambda k: F.concat(k, F.lit(": unknown")))
        found = F.when(here, F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), extra)).otherwise(found)
    return F.when(F.coalesce(known, F.lit(False)), found).otherwise(F.array(F.concat(F.coalesce(name, F.lit("")), F.lit(": unknown tool"))))


def _field(call: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(call, p, "variant") for p in paths])


def _arguments(call: Column) -> Column:
    """The arguments, parsed if they are JSON in a string."""
    a = _field(call, "$.arguments", "$.function.arguments")
    return F.coalesce(F.when(F.schema_of_variant(a) == "STRING", F.try_parse_json(F.try_variant_get(a, "$", "string"))), a)


def _references(arguments: Column) -> Column:
    """The names in argument values that are exactly "$name"."""
    values = F.map_values(F.from_json(F.to_json(arguments), "map<string,variant>"))
    texts = F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    found = F.transform(F.filter(texts, lambda t: F.coalesce(t.startswith("$") & (F.length(t) > 1), F.lit(False))), lambda t: F.substr(t, F.lit(2)))
    return F.when(F.schema_of_variant(arguments).startswith("OBJECT"), found)


def units(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, nth, kind ('message', 'call' or 'result'), id, name, arguments, after, content, whole, role, text.

    One row for each call and result, and one for each message that holds neither or has content beside its calls (then
    after them, with that content). whole: a call as it stands.
    """
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    maybe = lambda key: F.coalesce(F.ltrim("text").startswith("{") & F.contains("text", F.lit(f'"{key}')) & F.try_parse_json("text").isNotNull(), F.lit(False))
    calls = F.when((F.col("role") == "assistant") & maybe("tool_calls"), F.from_json("text", _CALLS))
    parsed = F.from_json("text", _RESULTS)
    single = F.when(parsed["tool_call_id"].isNotNull(), F.array(F.struct(parsed["tool_call_id"].alias("call_id"), parsed["content"].alias("content"))))
    results = F.when((F.col("role") == "tool") & maybe("tool_"), F.coalesce(parsed["tool_results"], single))
    rows = base.withColumn("calls", calls).withColumn("results", results)
    none, no_list, no_variant = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("variant")
    unit = lambda kind, id, name, arguments, after, content, whole=no_variant: F.struct(F.lit(kind).alias("kind"), id.alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"), content.alias("content"), whole.alias("whole"))
    call = lambda c: unit("call", F.try_variant_get(c, "$.id", "string"), F.coalesce(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.function.name", "string")), _arguments(c), F.try_variant_get(c, "$.after", "array<string>"), no_variant, c)
    beside = F.when(F.col("calls.content").isNotNull() & (F.schema_of_variant("calls.content") != "VOID"), F.array(unit("message", none, none, no_variant, no_list, F.col("calls.content"))))
    each = (
        F.when(F.size("calls.tool_calls") > 0, F.concat(F.transform("calls.tool_calls", call), F.coalesce(beside, F.filter(F.array(unit("message", none, none, no_variant, no_list, no_variant)), lambda x: F.lit(False)))))
        .when(F.size("results") > 0, F.transform("results", lambda r: unit("result", r["call_id"], none, no_variant, no_list, r["content"])))
        .otherwise(F.array(unit("message", none, none, no_variant, no_list, no_variant)))
    )
    return rows.select("conv_id", "turn", "role", "text", F.posexplode(each).alias("nth", "u")).select("conv_id", "turn", "role", "text", "nth", "u.*")


def levels(known: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, id, level of the calls (conv_id, id; distinct) that do not wait for a cycle.

    needs: conv_id, id, need (distinct), all of them known; a written table. Each round writes the calls that have become
    ready, next to those of the rounds before, and what the others still wait for.
    """
    spark = known.sparkSession
    folder = f"{shared_dir(spark)}/calls-levels-{uuid.uuid4().hex}"
    waiting = written(needs.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n")), "calls-waiting")
    ready, level = known.join(waiting, ["conv_id", "id"], "left_anti").select("conv_id", "id"), 0
    while True:
        ready.write.parquet(f"{folder}/level={level}")
        ready = spark.read.schema(ready.schema).parquet(f"{folder}/level={level}")
        met = needs.join(ready.withColumnRenamed("id", "need"), ["conv_id", "need"]).groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("m"))
        left = written(waiting.join(met, ["conv_id", "id"], "left").select("conv_id", "id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")), "calls-waiting")
        discard(waiting)
        ready, waiting, level = left.where("n = 0").select("conv_id", "id"), left, level + 1
        if ready.isEmpty():
            break
        waiting = written(left.where("n > 0"), "calls-waiting")
        ready = written(ready, "calls-ready")
        discard(left)
    return spark.read.schema("conv_id long, id string, level int").parquet(folder)


def linked(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row for each unit: conv_id, turn, nth, kind, call_id, level, status, problems, sort_turn, sort_level, json.

    Order within a conversation: sort_turn (a result stands at its call's turn), sort_level (the call's level), call_id,
    kind (a call before its results), turn, nth. status: 'linked' (a call with a result and its results),
    'unanswered', 'orphan' (a result without an earlier call), 'duplicate' (a call whose identifier an earlier one has, or a
    second result), 'cycle', 'unidentified' (no identifier); null for messages. json: the unit as canonical JSON, with
    the text of a message or of an unreadable call as a string, and every key of a call. A null conv_id is a conversation of its own kind whose
    units are not linked; null turns sort first; repeated rows are duplicates. Other columns are ignored.
    """
    tools = EXAMPLE_TOOLS if tools is None else tools
    rows = written(units(conversations), "calls-units")
    special = rows.where((F.col("kind") != "message") & F.col("conv_id").isNotNull() & F.col("id").isNotNull())
    order = F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "nth")
    calls = special.where("kind = 'call'")
    none = F.array().cast("array<string>")
    first = written(calls.groupBy("conv_id", "id").agg(F.min(order).alias("call_at")), "calls-first")
    answered = special.where("kind = 'result'").groupBy("conv_id", "id").agg(F.min(order).alias("result_at"))
    needs = calls.select("conv_id", "id", F.explode(F.concat(F.coalesce("after", none), F.coalesce(_references(F.col("arguments")), none))).alias("need")).distinct()
    # What no call of the conversation has as its identifier is waited for by nobody.
    needs = written(needs.join(first.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi"), "calls-needs")
    level = levels(first.select("conv_id", "id"), needs)
    known_names = needs.groupBy("conv_id", "id").agg(F.collect_set(F.concat(F.lit("$"), F.col("need"))).alias("names"))
    ids = first.join(answered, ["conv_id", "id"], "full").join(level, ["conv_id", "id"], "left").join(known_names, ["conv_id", "id"], "left")
    known = rows.join(ids, ["conv_id", "id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    has_call = F.col("call_at").isNotNull()
    early = is_result & (~has_call | (order < F.col("call_at")))
    status = (
        F.when(F.col("kind") == "message", F.lit(None))
        .when(F.col("conv_id").isNull() | F.col("id").isNull(), "unidentified")
        .when(is_call & (order != F.col("call_at")), "duplicate")
        .when(early, "orphan")
        .when(is_result & (order != F.col("result_at")), "duplicate")
        .when(has_call & F.col("level").isNull(), "cycle")
        .when(is_call & (F.col("result_at").isNull() | (F.col("result_at") < F.col("call_at"))), "unanswered")
        .otherwise("linked")
    )
    wrong = F.when(is_call, problems(F.col("name"), F.col("arguments"), tools, F.coalesce("names", none)))
    plain = F.to_json(F.struct(F.col("role"), F.col("text")))
    plain = F.when(F.col("content").isNotNull(), F.to_json(F.struct(F.col("role"), F.col("content")))).otherwise(plain)
    result = F.to_json(F.struct(F.col("id").alias("call_id"), F.col("content")))
    text = canonical(F.when(is_call, F.to_json("whole")).when(is_result, result).otherwise(plain))
    return known.select(
        "conv_id", "turn", "nth", "kind", F.col("id").alias("call_id"), F.when(is_call | is_result, F.col("level")).alias("level"), status.alias("status"), wrong.alias("problems"),
        F.when(is_result & (status == "linked"), F.col("call_at.turn")).otherwise(F.col("turn")).alias("sort_turn"), F.coalesce("level", F.lit(0)).alias("sort_level"), text.alias("json"),
    )
