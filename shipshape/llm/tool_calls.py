"""Chat formatting with tool-call linking, in DataFrame operations only.

Assistant texts hold calls as ``<tool_call>{"id":…, "name":…, "arguments":{…}, "after":…}</tool_call>``
and any text holds results as ``<tool_result>{"id":…, "content":…}</tool_result>``. Calls and results
are hash-joined by conversation and identifier, arguments are checked against the tools' schemas,
calls are put after the call that they name in ``after`` and after its result, and every event of a
chat is serialised as canonical JSON (sorted keys, no spaces).

``after`` makes calls a forest, whose depths come from pointer doubling: a number of joins that is
logarithmic in the longest chain. Events keep one row each and positions are counted over a range
partitioning of all events, so a conversation of any length is never gathered.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipshape.llm.common import staged

#: tool -> parameter -> (type, required)
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"key": ("string", True), "exact": ("boolean", False)},
    "convert": {"amount": ("number", True), "unit": ("string", True)},
}
#: How the types of a schema read as types of a JSON value.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
         "object": "OBJECT.*", "array": "ARRAY.*"}
_KEY = ["conv_id", "id"]


def _quoted(c: Column) -> Column:
    """A JSON value of a string column (null where it is null)."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(listed.substr(F.lit(2), F.length(listed) - 2))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _marked(messages: DataFrame, mark: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(f"(?s)<{mark}>(.*?)</{mark}>"), F.lit(1))
    return messages.select("conv_id", "turn", "role", F.posexplode(found).alias("n", "raw")).withColumn(
        "v", F.try_parse_json("raw"))


def parsed_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n, raw, id, name, after, args): the calls in assistant messages; id is null if malformed."""
    calls = _marked(messages.where("role = 'assistant'"), "tool_call")
    args = F.to_json(F.try_variant_get(F.col("v"), "$.arguments", "variant"))
    return calls.select("conv_id", "turn", "n", "raw", _field(F.col("v"), "id").alias("id"),
                        _field(F.col("v"), "name").alias("name"), _field(F.col("v"), "after").alias("after"),
                        args.alias("args"))


def parsed_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n, raw, id, content): the results in messages of any role."""
    results = _marked(messages, "tool_result")
    return results.select("conv_id", "turn", "n", "raw", _field(F.col("v"), "id").alias("id"),
                          F.to_json(F.try_variant_get(F.col("v"), "$.content", "variant")).alias("content"))


def argument_errors(name: Column, args: Column, schemas=None) -> Column:
    """What is wrong with a call's arguments, sorted and comma-joined; empty if nothing is."""
    schemas = SCHEMAS if schemas is None else schemas
    v = F.try_parse_json(args)
    keys = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    shape = F.coalesce(F.schema_of_variant(v).rlike("^OBJECT"), F.lit(False))
    found = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool"))).when(
        ~shape, F.array(F.lit("arguments are no object")))
    for tool, params in schemas.items():
        wrong = []
        for p, (kind, required) in params.items():
            got = F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant"))
            wrong.append(F.when(got.isNull(), F.lit(f"missing {p}") if required else none)
                         .when(~got.rlike(f"^({TYPES[kind]})$"), F.lit(f"type of {p}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, params))), lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*wrong)), extra))
    return F.array_join(F.array_sort(found), ",")


def _firsts(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a flag whether they are the first of their conversation and identifier."""
    first = staged(rows.where("id IS NOT NULL").groupBy(*_KEY).agg(
        F.min(F.struct("turn", "n")).alias("least")), f"first-{name}")
    first = first.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "least")
    same = rows["conv_id"].eqNullSafe(first["c"]) & (rows["id"] == first["i"])
    return rows.join(first.hint("shuffle_hash"), same, "left").withColumn(
        "first", F.coalesce(F.struct("turn", "n") == F.col("least"), F.lit(False))).drop("c", "i", "least")


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth, late): how many calls precede each first call along ``after``, and the
    latest turn among them; depth is null in and behind a cycle. ``calls`` holds each call once
    with ``done``, the turn by which it and its result are there."""
    up = calls.select(F.col("conv_id").alias("c"), F.col("id").alias("up"), F.col("done").alias("up_done"))
    state = calls.join(up.hint("shuffle_hash"), calls["conv_id"].eqNullSafe(up["c"]) & (calls["after"] == up["up"]),
                       "left").select("conv_id", "id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0)
                                      .cast("long").alias("depth"), F.col("up_done").alias("late"))
    state = staged(state, "depth")
    rounds = math.ceil(math.log2(state.count() + 1)) + 1  # a chain without a cycle has ended by then
    while rounds and not state.where("up IS NOT NULL").isEmpty():
        far = state.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("up").alias("far"),
                           F.col("depth").alias("more"), F.col("late").alias("later"))
        going = state.where("up IS NOT NULL")
        going = going.join(far.hint("shuffle_hash"), going["conv_id"].eqNullSafe(far["c"]) & (going["up"] == far["i"])
                           ).select("conv_id", "id", F.col("far").alias("up"), (F.col("depth") + F.col("more"))
                                    .alias("depth"), F.greatest("late", "later").alias("late"))
        state = staged(state.where("up IS NULL").unionByName(going), "depth")
        rounds -= 1
    end = F.col("up").isNull()
    return state.select("conv_id", "id", F.when(end, F.col("depth")).alias("depth"),
                        F.when(end, F.col("late")).alias("late"))


def linked_events(messages: DataFrame, schemas=None) -> DataFrame:
    """All events without their positions: conv_id, kind, turn, n, call_id, name, depth, ready,
    level, status, errors, json."""
    calls = staged(_firsts(parsed_calls(messages), "calls"), "calls")
    results = staged(_firsts(parsed_results(messages), "results"), "results")

    own = calls.where("first").select("conv_id", "id", "turn", "after")
    answers = results.where("first").select(F.col("conv_id").alias("c"), F.col("id").alias("i"),
                                            F.col("turn").alias("answered"))
    own = own.join(answers.hint("shuffle_hash"), own["conv_id"].eqNullSafe(answers["c"]) & (own["id"] == answers["i"])
                   & (answers["answered"] >= own["turn"]), "left")
    own = staged(own.select("conv_id", "id", "turn", "after", "answered",
                            F.greatest("turn", "answered").alias("done")), "own")
    depth = _depths(own)
    placed = own.join(depth.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "depth", "late")
                      .hint("shuffle_hash"), own["conv_id"].eqNullSafe(F.col("c")) & (own["id"] == F.col("i")))
    placed = staged(placed.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "depth", "answered",
                                  F.greatest("turn", "late").alias("ready")), "placed")

    def with_place(rows: DataFrame) -> DataFrame:
        return rows.join(placed.hint("shuffle_hash"), rows["conv_id"].eqNullSafe(placed["c"])
                         & (rows["id"] == placed["i"]) & rows["first"], "left")

    errors = argument_errors(F.col("name"), F.col("args"), schemas)
    call = with_place(calls).withColumn("errors", F.when(F.col("id").isNotNull(), errors).otherwise(F.lit("malformed")))
    call = call.select(
        "conv_id", F.lit("call").alias("kind"), "turn", "n", F.col("id").alias("call_id"), "name", "depth",
        F.coalesce("ready", "turn").alias("ready"), F.coalesce(F.col("depth") * 2 + 1, F.lit(1)).alias("level"),
        F.when(F.col("id").isNull(), "malformed").when(~F.col("first"), "duplicate")
        .when(F.col("depth").isNull(), "cycle").when(F.col("errors") != "", "invalid")
        .when(F.col("answered").isNull(), "unanswered").otherwise("ok").alias("status"), "errors",
        F.when(F.col("id").isNull(), F.concat(F.lit('{"kind":"call","raw":'), _quoted(F.col("raw")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"after":'), _quoted(F.col("after")), F.lit(',"arguments":'),
                            F.coalesce("args", F.lit("null")), F.lit(',"id":'), _quoted(F.col("id")),
                            F.lit(',"kind":"call","name":'), _quoted(F.col("name")), F.lit("}"))).alias("json"))
    matched = F.col("answered").isNotNull() & (F.col("answered") == F.col("turn"))
    result = with_place(results).select(
        "conv_id", F.lit("result").alias("kind"), "turn", "n", F.col("id").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.when(matched, F.col("depth")).alias("depth"),
        F.when(matched, F.greatest("ready", "turn")).otherwise(F.col("turn")).alias("ready"),
        F.coalesce(F.when(matched, F.col("depth") * 2 + 2), F.lit(2)).alias("level"),
        F.when(F.col("id").isNull(), "malformed").when(~F.col("first"), "duplicate").when(matched, "ok")
        .otherwise("orphan").alias("status"), F.lit("").alias("errors"),
        F.when(F.col("id").isNull(), F.concat(F.lit('{"kind":"result","raw":'), _quoted(F.col("raw")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'),
                            _quoted(F.col("id")), F.lit(',"kind":"result"}'))).alias("json"))
    content = F.trim(F.regexp_replace("text", r"(?s)<(tool_call|tool_result)>.*?</\1>", ""))
    message = messages.select(
        "conv_id", F.lit("message").alias("kind"), "turn", F.lit(0).alias("n"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("depth"), F.col("turn").alias("ready"),
        F.lit(0).cast("long").alias("level"), F.lit("ok").alias("status"), F.lit("").alias("errors"),
        F.concat(F.lit('{"content":'), _quoted(content), F.lit(',"kind":"message","role":'), _quoted(F.col("role")),
                 F.lit("}")).alias("json"))
    return message.unionByName(call).unionByName(result)


def format_chats(messages: DataFrame, schemas=None) -> DataFrame:
    """One row per event: conv_id, position (from 0 in its conversation), kind (message, call,
    result), turn, call_id, name, depth, status, errors, json.

    Events stand in the order of the turn by which they are ready (a call not before the result
    of the call that it names in ``after``, a result not before its call), then by depth. Of calls
    that share an identifier in a conversation the first is linked and the others are duplicates;
    so with results. A result without an earlier call is an orphan, a call without a result
    unanswered; ``after`` without such a call counts as none; calls in or behind a cycle have no
    depth. Malformed JSON (repeated keys included) is kept as raw text. Null texts are empty, a
    null role is null in the JSON, null turns come first, null conv_ids are one conversation. Rows
    repeated whole count once. Further columns are not read. An empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    events = linked_events(staged(rows.distinct(), "messages"), schemas)
    order = ["conv_id", "ready", "level", "turn", "kind", "n", "json"]
    events = staged(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "events")
    parts = events.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    events = events.withColumn("nth", nth).join(F.broadcast(parts), "part").withColumn(
        "place", F.col("start") + F.col("nth"))
    events = staged(events, "places")
    first = staged(events.groupBy("conv_id").agg(F.min("place").alias("zero")), "zeros").withColumnRenamed("conv_id", "c")
    return events.join(first, events["conv_id"].eqNullSafe(first["c"])).select(
        "conv_id", (F.col("place") - F.col("zero")).alias("position"), "kind", "turn", "call_id", "name", "depth",
        "status", "errors", "json")


def derived_calls(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls, derived from each row alone of a table of plain conversations.

    Every assistant message gets a call whose tool, arguments, faults and predecessor follow from
    a checksum of the row; the message after it carries the result, or none, two, or one that
    belongs to no call.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.crc32(F.encode(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), text), "UTF-8"))
    id_at = lambda t: F.concat(F.lit("c"), t.cast("string"))
    turn = F.col("turn")
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    limit = F.when(h % 7 == 0, F.lit('"ten"')).otherwise((h % 50).cast("string"))
    search = F.concat(F.lit('{"limit":'), limit, F.when(h % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "query":'), _quoted(F.substring(text, 1, 40)))), F.lit("}"))
    args = F.when(h % 4 == 0, search).when(h % 4 == 1, js(key=F.substring(text, 1, 12), exact=h % 2 == 0)).when(
        h % 4 == 2, js(unit=F.lit("m"), amount=(h % 1000) / 8)).otherwise(js(key=F.lit("k")))
    tool = F.element_at(F.array(*map(F.lit, ("search", "lookup", "convert", "unknown"))), (h % 4 + 1).cast("int"))
    after = F.when((turn >= 2) & (h % 3 != 0), F.concat(F.lit(', "after":"'), id_at(turn - 2), F.lit('"'))).otherwise("")
    call = F.concat(F.lit('<tool_call>{"name":"'), tool, F.lit('", "id":"'), id_at(turn), F.lit('"'), after,
                    F.lit(', "arguments":'), args, F.when(h % 13 == 0, F.lit("")).otherwise(F.lit("}")),
                    F.lit("</tool_call>"))
    result = F.concat(F.lit("<tool_result>"), js(id=id_at(turn - 1), content=F.length(text)), F.lit("</tool_result>"))
    again = F.when(h % 5 == 0, F.lit("")).when(h % 17 == 0, F.concat(result, result)).otherwise(result)
    extra = F.when(F.col("role") == "assistant", call).when((turn >= 1) & (F.col("role") == "user"), again)
    return conversations.select("conv_id", "turn", "role", F.concat(text, F.coalesce(extra, F.lit(""))).alias("text"))
