"""Chat formatting with tool-call linking.

A message whose text is a JSON object may declare tools (``tools``: objects of ``name, parameters``), carry calls
(``tool_calls``: objects of ``id, name, arguments``) or be a result (``tool_call_id``, ``content``); tools and calls may
also stand nested in ``function``. Calls and results are linked by a hash join on conversation and
identifier, the earliest call of an identifier with the earliest result. A call depends on the calls whose
identifiers stand in its arguments; its level is the length of the longest such chain, and what has none lies in or
behind a cycle. Arguments are validated against the schema of their tool, as the conversation declares it first, else as
the caller gives it. Each message is serialised as canonical JSON: sorted keys, no white space, its calls in
topological order with their arguments, level, and whether they were answered and valid.

A row is one message, so a conversation of any length is never gathered in a task. Levels are solved per
conversation from pairs of identifiers alone; conversations with more than ``EDGES`` pairs go round by round.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .scratch import Scratch

#: Pairs of dependent calls up to which one task solves a conversation: about 100 bytes each.
EDGES = 200_000
#: Declared schemas up to which they are broadcast, by their characters.
BROADCAST_CHARS = 20_000_000
CALL = "struct<id:string,name:string,arguments:string,proper:boolean,mentions:array<string>>"
TOOL = "struct<name:string,schema:string>"
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and without white space, whatever the depth."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # text that is ready
            out.append(x[0])
        elif isinstance(x, dict):
            parts = [p for k in sorted(x) for p in ((",",), (json.dumps(k, ensure_ascii=False) + ":",), x[k])]
            todo += [("}",), *reversed(parts[1:]), ("{",)]
        elif isinstance(x, list):
            parts = [p for v in x for p in ((",",), v)]
            todo += [("]",), *reversed(parts[1:]), ("[",)]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _fits(value, schema: dict) -> bool:
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _KINDS.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, dict):
        return all(k in value for k in schema.get("required", []))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    return True


def validate(value, schema: dict) -> bool:
    """Validation against ``type, enum, const, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength``."""
    todo = [(value, schema)]
    while todo:
        v, rule = todo.pop()
        if rule is False:
            return False
        if not isinstance(rule, dict):
            continue
        if not _fits(v, rule):
            return False
        if isinstance(v, dict):
            known, more = rule.get("properties", {}), rule.get("additionalProperties", True)
            todo += [(inner, known.get(k, more)) for k, inner in v.items()]
        elif isinstance(v, list):
            todo += [(inner, rule.get("items")) for inner in v]
    return True


def strings(value) -> set[str]:
    """All strings inside a JSON value but for keys."""
    out, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.add(x)
        elif isinstance(x, (dict, list)):
            todo += x.values() if isinstance(x, dict) else x
    return out


def _inner(item) -> tuple[dict, dict]:
    """An object, and the object that names its function: nested in it or itself."""
    item = item if isinstance(item, dict) else {}
    return item, item["function"] if isinstance(item.get("function"), dict) else item


def _loaded(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def parse(text: str | None) -> tuple[str | None, list[dict], str | None, list[dict]]:
    """Content, calls, the identifier that the message answers and the tools it declares; other text is plain content.

    So is JSON nested deeper than Python's parser goes, or with code points that UTF-8 lacks. A call without
    a proper identifier, name or arguments stays, as an improper one.
    """
    value = _loaded(text) if text and text.lstrip()[:1] == "{" else None
    if not isinstance(value, dict) or not value.keys() & {"tool_calls", "tool_call_id", "tools"}:
        return text, [], None, []
    listed = lambda name: value[name] if isinstance(value.get(name), list) else []
    string = lambda x: x if isinstance(x, str) else None
    try:
        canonical(value).encode()
        calls = []
        for item in listed("tool_calls"):
            call, function = _inner(item)
            arguments = function.get("arguments", {})
            arguments = _loaded(arguments) if isinstance(arguments, str) else arguments
            id_, name = string(call.get("id")), string(function.get("name"))
            encoded = canonical(arguments)
            encoded.encode()
            proper = id_ is not None and name is not None and isinstance(arguments, dict)
            calls.append({"id": id_, "name": name, "arguments": encoded, "proper": proper, "mentions": sorted(strings(arguments) - {id_})})
        tools = [{"name": f["name"], "schema": canonical(f.get("parameters", {}))} for _, f in map(_inner, listed("tools")) if isinstance(f.get("name"), str)]
    except UnicodeEncodeError:
        return text, [], None, []
    content = value.get("content")
    return (content if content is None or isinstance(content, str) else canonical(content)), calls, string(value.get("tool_call_id")), tools


def solve(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Level of every identifier in ``(identifier, what it needs)`` pairs; none in or behind a cycle."""
    waits: dict[str, int] = {}
    needed_by: dict[str, list[str]] = {}
    for a, b in edges:
        waits[a] = waits.get(a, 0) + 1
        needed_by.setdefault(b, []).append(a)
    level = {b: 0 for b in needed_by if b not in waits}
    todo = list(level)
    for b in todo:
        for a in needed_by.get(b, ()):
            waits[a] -= 1
            if not waits[a]:
                level[a] = level[b] + 1
                todo.append(a)
    return level


def _levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, id, level``: 0 for calls that depend on none, else one more than the deepest they depend on, null in or behind a cycle."""
    ids = calls.select("conv", "id").distinct()
    needs = calls.select("conv", "id", F.explode("mentions").alias("need")).distinct()
    needs = scratch.keep(needs.join(ids.withColumnRenamed("id", "need"), ["conv", "need"], "left_semi"), "needs")
    sizes = needs.groupBy("conv").agg(F.count("*").alias("n"))
    small = needs.join(sizes.filter(F.col("n") <= EDGES).select("conv"), "conv")

    def run(pairs: pa.Table) -> pa.Table:
        level = solve(list(zip(pairs["id"].to_pylist(), pairs["need"].to_pylist(), strict=True)))
        columns = [[pairs["conv"][0].as_py()] * len(level), list(level), list(level.values())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["conv", "id", "level"])

    kind = "conv string, id string, level int"
    placed = [small.groupBy("conv").applyInArrow(run, kind)]
    large = scratch.keep(needs.join(sizes.filter(F.col("n") > EDGES).select("conv"), "conv"), "large")
    if not large.isEmpty():
        placed.append(_peeled(large, scratch))
    known = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    # What depends on nothing is not among the pairs' left sides.
    alone = ids.join(needs.select("conv", "id").distinct(), ["conv", "id"], "left_anti").withColumn("level", F.lit(0))
    return alone.unionByName(known.filter("level > 0"))


def _peeled(needs: DataFrame, scratch: Scratch) -> DataFrame:
    """Levels round by round; each adds its rows to one table, and looks only at pairs that wait still."""
    path, spark, kind = scratch.path("levels"), needs.sparkSession, "conv string, id string, level int"
    held = needs.select("conv", "id").distinct()
    nxt = needs.select("conv", F.col("need").alias("id")).distinct().join(held, ["conv", "id"], "left_anti").withColumn("level", F.lit(0))
    level, waiting = 0, needs
    while True:
        nxt = scratch.keep(nxt, "ready")
        nxt.write.mode("append").parquet(path)
        if nxt.isEmpty():
            return spark.read.schema(kind).parquet(path)
        level += 1
        left = scratch.keep(waiting.join(nxt.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_anti"), "waiting")
        freed = waiting.select("conv", "id").distinct().join(left.select("conv", "id").distinct(), ["conv", "id"], "left_anti")
        waiting, nxt = left, freed.withColumn("level", F.lit(level))


def _validated(calls: DataFrame, tools: DataFrame, schemas: dict[str, dict], scratch: Scratch) -> DataFrame:
    """``calls`` with ``valid``: null where no schema of the tool is known, false for improper calls."""
    tools = tools.groupBy("conv", "name").agg(F.min_by("schema", F.struct("turn", "schema")).alias("schema"))
    tools = scratch.keep(tools, "tools")
    few = (tools.agg(F.sum(F.length("schema"))).first()[0] or 0) <= BROADCAST_CHARS
    rows = calls.join(F.broadcast(tools) if few else tools, ["conv", "name"], "left")

    def judge(arguments: str, name: str, schema: str | None) -> bool | None:
        rule = json.loads(schema) if schema is not None else schemas.get(name)
        return None if rule is None else validate(json.loads(arguments), rule)

    def run(batches):
        for b in slices(batches):
            out = []
            for a, n, s, proper in zip(*(b.column(k).to_pylist() for k in ("arguments", "name", "schema", "proper")), strict=True):
                try:
                    out.append(judge(a, n, s) if proper else False)
                except (RecursionError, TypeError, AttributeError):  # nested too deep to compare, or no proper schema
                    out.append(False)
            yield pa.record_batch([*[b.column(k) for k in ("conv", "uid", "at", "id", "name", "arguments")], pa.array(out, pa.bool_())], ["conv", "uid", "at", "id", "name", "arguments", "valid"])

    kind = "conv string, uid bigint, at int, id string, name string, arguments string, valid boolean"
    return rows.select("conv", "uid", "at", "id", "name", "arguments", "schema", "proper").mapInArrow(run, kind)


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message: ``conv_id, turn, role, n_calls, n_answered, n_invalid, answers_turn, level, message``.

    ``level`` orders messages topologically within the conversation: twice the deepest level of its calls, or one
    more than that of the call it answers; null where its calls lie in or behind a cycle, 0 for plain messages. Calls of tools
    without a schema have ``valid`` null. Null fields are JSON nulls, and rows with a null conversation are one conversation; identifiers
    that repeat count where they stand first; results without a call and calls without a result or identifier
    stay, unlinked. Texts of any length are read whole. Repeated rows give a row each; extra columns are not read; an empty table gives no rows.
    """
    scratch, schemas = Scratch(messages.sparkSession, "chat"), schemas or {}

    def run(batches):
        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("proper", pa.bool_()), ("mentions", pa.list_(pa.string()))])
        kinds = (pa.string(), pa.list_(call), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])))
        for b in slices(batches):
            rows = [parse(t) for t in b.column(3).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *columns], ["conv_id", "turn", "role", "content", "calls", "answers", "tools"])

    parsed = messages.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id bigint, turn bigint, role string, content string, calls array<{CALL}>, answers string, tools array<{TOOL}>")
    parsed = parsed.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    parsed = scratch.keep(parsed.withColumn("uid", F.monotonically_increasing_id()), "parsed")
    calls = parsed.filter(F.size("calls") > 0).select("conv", "turn", "uid", F.posexplode("calls").alias("at", "c")).select("conv", "turn", "uid", "at", "c.*")
    tools = parsed.filter(F.size("tools") > 0).select("conv", "turn", F.inline("tools"))
    linkable = calls.filter(F.col("id").isNotNull())
    first = linkable.groupBy("conv", "id").agg(F.min("turn").alias("call_turn"))
    answers = parsed.filter(F.col("answers").isNotNull()).groupBy("conv", F.col("answers").alias("id")).agg(F.min("turn").alias("result_turn"), F.lit(True).alias("answered"))
    links = scratch.keep(first.join(answers, ["conv", "id"], "left").join(_levels(linkable, scratch), ["conv", "id"], "left"), "links")
    told = _validated(calls, tools, schemas, scratch).join(links, ["conv", "id"], "left").groupBy("uid").agg(
        # In topological order, those without a level last.
        F.sort_array(F.collect_list(F.struct(F.col("level").isNull().alias("last"), "level", "at", "id", "name", "arguments", "valid", F.coalesce("answered", F.lit(False)).alias("answered")))).alias("linked"),
        F.max("level").alias("deepest"),
        F.max(F.col("level").isNull() & F.col("id").isNotNull()).alias("cyclic"),
    )
    results = parsed.filter(F.col("answers").isNotNull()).select("uid", "conv", F.col("answers").alias("id")).join(links, ["conv", "id"])
    results = results.select("uid", "call_turn", F.col("level").alias("call_level"), F.lit(True).alias("found"))
    out = parsed.join(told, "uid", "left").join(results, "uid", "left")
    linked = F.coalesce("linked", F.array().cast("array<struct<last:boolean,level:int,at:int,id:string,name:string,arguments:string,valid:boolean,answered:boolean>>"))
    text = lambda c: F.coalesce(F.substring(F.to_json(F.array(c)), 2, 2**31 - 1), F.lit("null]"))
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(text(c), r"\]\z", ""))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    call = lambda x: F.concat(
        F.lit('{"answered":'), x["answered"].cast("string"), F.lit(',"arguments":'), x["arguments"],
        F.lit(',"id":'), quoted(x["id"]), F.lit(',"level":'), number(x["level"]), F.lit(',"name":'), quoted(x["name"]),
        F.lit(',"valid":'), number(x["valid"]), F.lit("}"),
    )
    message = F.concat(
        F.lit('{"answers":'), quoted(F.col("answers")), F.lit(',"calls":['), F.array_join(F.transform(linked, call), ","),
        F.lit('],"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"turn":'), number(F.col("turn")), F.lit("}"),
    )
    level = F.when(F.col("cyclic"), F.lit(None)).when(F.col("deepest").isNotNull(), 2 * F.col("deepest")).when(F.col("found"), 2 * F.col("call_level") + 1).otherwise(0)
    return out.select(
        "conv_id", "turn", "role", F.size("calls").cast("long").alias("n_calls"),
        F.size(F.filter(linked, lambda x: x["answered"])).cast("long").alias("n_answered"),
        F.size(F.filter(linked, lambda x: ~x["valid"])).cast("long").alias("n_invalid"),
        F.col("call_turn").alias("answers_turn"), level.cast("int").alias("level"), message.alias("message"),
    )
