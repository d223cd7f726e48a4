"""Chat formatting: tool calls linked with their results, ordered, validated and serialised as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace

#: Tools that a production corpus is checked against, as JSON schemas of their arguments.
TOOLS: dict[str, dict] = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "required": ["url"], "additionalProperties": False},
}
#: What ``schema_of_variant`` says of each JSON type.
_TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _key(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def schema_errors(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """Sorted complaints about a call: ``unknown_tool``, ``no_object``, ``missing:x``, ``type:x``, ``unknown:x``."""
    none = F.array().cast("array<string>")
    kind = F.schema_of_variant(arguments)
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), none)
    out = F.array(F.lit("unknown_tool"))
    for tool, schema in sorted(tools.items()):
        found = []
        for field, spec in sorted(schema.get("properties", {}).items()):
            there = F.array_contains(keys, field)
            right = F.schema_of_variant(_at(arguments, _key(field), "variant")).rlike(_TYPES[spec["type"]]) if "type" in spec else F.lit(True)
            found.append(F.when(there & ~F.coalesce(right, F.lit(False)), F.lit(f"type:{field}")))
        found += [F.when(~F.array_contains(keys, field), F.lit(f"missing:{field}")) for field in schema.get("required", [])]
        known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
        extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k)) if schema.get("additionalProperties") is False else none
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found).cast("array<string>")), extra))
        out = F.when(name == tool, F.when(kind.rlike("^OBJECT"), errors).otherwise(F.array(F.lit("no_object")))).otherwise(out)
    return F.when(arguments.isNull(), F.array(F.lit("no_object"))).otherwise(out)


def _levels(ws: Workspace, calls: DataFrame) -> DataFrame:
    """conv_id, id, level: 0 for calls that wait for no other, else one more than the highest they wait for; null in a cycle.

    Waits that name no call of the conversation are met from the start.  Every wait has a length, and its
    end's level once that is known.  In each round a wait for a call that itself waits for one call only is
    passed on to that one, so chains halve; calls whose waits all end in known levels have theirs.  So a
    chain of n calls takes some log2(n) rounds, each of one aggregation and one join, with the waits staged.
    A round that makes no call known leaves cycles and what waits for them.
    """
    nodes = calls.select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode("after").alias("dep")).distinct()
    edges = edges.join(nodes.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"], "left_semi")
    edges = ws.stage(edges.select("conv_id", "id", "dep", F.lit(1).cast("long").alias("far"), F.lit(None).cast("long").alias("known")), "edges")
    waits, before = edges.count(), -1
    if not waits:
        return nodes.withColumn("level", F.lit(0))
    whole = F.bool_and(F.col("known").isNotNull())
    while True:
        ends = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("dep").alias("dep2"), F.min("far").alias("far2"), F.when(whole, F.max(F.col("known") + F.col("far"))).alias("level"))
        done = edges.filter("known is not null").count()
        if done in (before, waits):
            return nodes.join(ends.select("conv_id", "id", "level", F.lit(True).alias("_waits")), ["conv_id", "id"], "left").select("conv_id", "id", F.when(F.col("_waits"), F.col("level").cast("int")).otherwise(0).alias("level"))
        beyond = ends.select("conv_id", F.col("id").alias("dep"), "n", "dep2", "far2", "level")
        met = edges.join(beyond, ["conv_id", "dep"], "left")
        # a call with no row of its own waits for nothing: level 0
        now = F.coalesce("known", F.when(F.col("n").isNull(), 0).otherwise(F.col("level")))
        on = now.isNull() & (F.col("n") == 1)
        after = ws.stage(met.select("conv_id", "id", F.when(on, F.col("dep2")).otherwise(F.col("dep")).alias("dep"), F.when(on, F.least(F.col("far") + F.col("far2"), F.lit(1 << 40))).otherwise(F.col("far")).alias("far"), now.alias("known")), "edges")
        ws.drop(edges)
        edges, before = after, done


#: A running value passes along blocks of 2**TURN_BITS turns, so no task holds a whole conversation.
TURN_BITS = 10
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def _answers(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, id, at, owner (at and part of the latest call up to ``at``) and r (turn and content of that
    call's earliest result); one row for each identifier and turn with calls or results.

    ``at`` is the turn; calls without one come first, results without one last.  Only one row for each turn
    is ordered: its last call and its least result.  The latest call runs through a block of turns, and
    one row a block carries it on.
    """
    of_turn = lambda df, at, *agg: df.filter("id is not null and conv_id is not null").groupBy("conv_id", "id", at.alias("at")).agg(*agg)
    last = of_turn(calls, F.coalesce("turn", F.lit(_FIRST)), F.max("part").alias("part"))
    least = of_turn(results, F.coalesce("turn", F.lit(_LAST)), F.min(F.struct("turn", F.to_json("content").alias("content"))).alias("r"))
    each = last.join(least, ["conv_id", "id", "at"], "full").withColumn("block", F.shiftright("at", TURN_BITS))
    call = F.when(F.col("part").isNotNull(), F.struct("at", "part"))
    before = Window.partitionBy("conv_id", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.groupBy("conv_id", "id", "block").agg(F.max(call).alias("c")).select("conv_id", "id", "block", F.max("c").over(before).alias("carried"))
    so_far = Window.partitionBy("conv_id", "id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = each.withColumn("c", F.max(call).over(so_far)).join(carried, ["conv_id", "id", "block"]).select("conv_id", "id", "at", F.coalesce("c", "carried").alias("owner"), "r")
    first = owned.filter("r is not null and owner is not null").groupBy("conv_id", "id", "owner").agg(F.min(F.struct("at", "r")).getField("r").alias("r"))
    return owned.drop("r").join(first, ["conv_id", "id", "owner"], "left")


def as_calls(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text: conversations of plain messages with every answer told as a tool call and its result.

    For transcripts of tool users that were stored as prose.  A turn of a user stays, at twice its turn.  An
    assistant's turn t becomes two: at 2t a call ``answer-t`` of the tool ``answer`` with the turn and the
    user's text of turn t - 1 (absent if there is none), which waits for the call of turn t - 2; and at
    2t + 1 a ``tool`` turn with the text as its result.  Other roles stay as they are, at twice their turn.
    A text that is a JSON object with calls of its own, or a row without turn or conversation, stays, too.
    Rows of one turn are told apart by nothing, so repeated rows give repeated calls.  One join by
    conversation and turn with the users' texts, of which a repeated turn counts once, the least text.
    """
    col = lambda c, kind: F.col(f"`{c}`").cast(kind)
    base = turns.select(col(conv_col, "long").alias("conv_id"), col(turn_col, "long").alias("turn"), col(role_col, "string").alias("role"), col(text_col, "string").alias("text"))
    asked = base.filter("lower(role) = 'user' and conv_id is not null and turn is not null").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("asked"))
    own = F.coalesce(F.try_parse_json("text"), F.parse_json(F.lit("null")))
    answers = (F.lower("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & ~(F.ltrim(F.coalesce("text", F.lit(""))).startswith("{") & F.coalesce(_at(own, "$.tool_calls", "array<variant>").isNotNull(), F.lit(False)))
    both = base.join(asked, ["conv_id", "turn"], "left").withColumn("_answer", F.coalesce(answers, F.lit(False)))
    name = lambda t: F.concat(F.lit("answer-"), t.cast("string"))
    call = F.struct(F.struct(F.col("asked").alias("question"), "turn").alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"), name(F.col("turn")).alias("id"), F.lit("answer").alias("name"))
    told = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), name(F.col("turn")).alias("tool_call_id")))
    one = lambda shift, role, text: F.struct((F.col("turn") * 2 + shift).alias("turn"), role.alias("role"), text.alias("text"))
    rows = F.when(F.col("_answer"), F.array(one(0, F.col("role"), told), one(1, F.lit("tool"), result))).otherwise(F.array(one(0, F.col("role"), F.col("text"))))
    return both.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")


#: The schema of what ``as_calls`` makes.
ANSWER: dict[str, dict] = {"answer": {"properties": {"question": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["question", "turn"], "additionalProperties": False}}


def format_chat(turns: DataFrame, tools: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_call: bool = False) -> DataFrame:
    """One row per message, tool call and tool result, to be read in the order conv_id, turn, level, part.

    * A text that is a JSON object with ``tool_calls`` (id, name or function.name, arguments as object or
      string, after: ids it waits for) makes one ``call`` row for each, besides its message.
    * A turn of role ``tool`` whose text is an object with ``tool_call_id`` is a ``result``.
    * Calls and results meet by (conv_id, identifier) in a hash join.  Either side is first reduced to one
      row per identifier, the earliest by turn and place, so a repeated identifier never makes pairs and a
      conversation that holds a third of all rows is never gathered: ``status`` is ``linked``,
      ``no_result``, ``repeated`` (another call had the identifier before), ``no_id``; for results
      ``linked``, ``no_call``, ``early`` (before its call), ``repeated``.
    * With ``per_call``, nothing is reduced to the earliest: each result goes to the latest call of its
      identifier before it (or in its turn), so an identifier may be used again and a stray result hides no
      later one.  A call is ``linked`` to its own earliest result, ``repeated`` without one if another call
      had the identifier before; a result is ``early`` before all calls, ``repeated`` after its call's first.
    * ``level`` orders the calls of a turn topologically; calls in a cycle have none.
    * ``errors`` lists what the call's arguments lack against the tool's schema (see ``schema_errors``).
    * ``json`` is canonical: keys sorted, no blanks, absent values left out; a linked call carries its result.

    Null texts are empty messages; a null role is ``unknown``; rows without conv_id are never linked; wholly
    equal rows get equal rows; broken JSON is a plain message; an empty table gives an empty one; other
    columns are ignored.  SQL functions only.
    """
    tools = TOOLS if tools is None else tools
    ws = Workspace(turns.sparkSession, "chat")
    col = lambda c, kind: F.col(f"`{c}`").cast(kind)
    base = turns.select(col(conv_col, "long").alias("conv_id"), col(turn_col, "long").alias("turn"), F.coalesce(F.lower(col(role_col, "string")), F.lit("unknown")).alias("role"), F.coalesce(col(text_col, "string"), F.lit("")).alias("text"))
    v = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    parsed = base.withColumn("v", v)
    objects = base.filter(F.ltrim("text").startswith("{")).withColumn("v", F.try_parse_json("text"))
    raw = F.posexplode(F.coalesce(_at(F.col("v"), "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))).alias("part", "c")
    text_args = F.coalesce(_at(F.col("c"), "$.function.arguments", "string"), _at(F.col("c"), "$.arguments", "string"))
    args = F.coalesce(_at(F.col("c"), "$.function.arguments", "variant"), _at(F.col("c"), "$.arguments", "variant"))
    is_text = F.schema_of_variant(args) == "STRING"
    calls = objects.filter("role <> 'tool'").select("conv_id", "turn", raw).select(
        "conv_id", "turn", "part", _at(F.col("c"), "$.id", "string").alias("id"), F.coalesce(_at(F.col("c"), "$.function.name", "string"), _at(F.col("c"), "$.name", "string")).alias("name"), F.when(is_text, F.try_parse_json(text_args)).otherwise(args).alias("arguments"), F.coalesce(_at(F.col("c"), "$.after", "array<string>"), F.array().cast("array<string>")).alias("after")
    )
    results = objects.filter("role = 'tool'").select("conv_id", "turn", "text", _at(F.col("v"), "$.tool_call_id", "string").alias("id"), _at(F.col("v"), "$.content", "variant").alias("content")).filter("id is not null")

    first_call = calls.filter("id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "part")).alias("first"))
    # variants can't be aggregated: the earliest result travels as its canonical text
    first_result = results.filter("conv_id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", F.to_json("content").alias("content"))).alias("r"))
    levels = _levels(ws, calls.filter("id is not null and conv_id is not null").select("conv_id", "id", "after"))
    heads = first_call.join(first_result, ["conv_id", "id"], "left").join(levels, ["conv_id", "id"], "left")

    mine = F.col("first").eqNullSafe(F.struct("turn", "part")) if per_call else F.col("first") == F.struct("turn", "part")
    if per_call:
        answers = ws.stage(_answers(calls, results), "answers")
        own = answers.select("conv_id", "id", F.col("owner.at").alias("at"), F.col("owner.part").alias("part"), "r").filter("r is not null").distinct()
        linked = calls.withColumn("at", F.coalesce("turn", F.lit(_FIRST))).join(heads.drop("r"), ["conv_id", "id"], "left").join(own, ["conv_id", "id", "at", "part"], "left")
        status = F.when(F.col("id").isNull() | F.col("conv_id").isNull(), "no_id").when(F.col("r").isNotNull(), "linked").when(~mine, "repeated").otherwise("no_result")
    else:
        linked = calls.join(heads, ["conv_id", "id"], "left")
        good = mine & F.col("r").isNotNull() & (F.coalesce(F.col("r.turn") >= F.col("turn"), F.lit(True)))
        status = F.when(F.col("id").isNull() | F.col("conv_id").isNull(), "no_id").when(~mine, "repeated").when(good, "linked").otherwise("no_result")
    body = F.struct(F.col("arguments"), F.col("id"), F.col("name"), F.when(status == "linked", F.try_parse_json(F.col("r.content"))).alias("result"))
    call_rows = linked.select("conv_id", "turn", "part", F.lit("call").alias("kind"), F.col("id").alias("call_id"), "name", "level", status.alias("status"), F.array_join(schema_errors(F.col("name"), F.col("arguments"), tools), ",").alias("errors"), F.to_json(body).alias("json"))

    if per_call:
        answered = results.withColumn("at", F.coalesce("turn", F.lit(_LAST))).join(heads.select("conv_id", "id", "first"), ["conv_id", "id"], "left").join(answers, ["conv_id", "id", "at"], "left")
        state = F.when(F.col("first").isNull(), "no_call").when(F.col("owner").isNull(), "early").when(F.col("r").eqNullSafe(F.struct("turn", F.to_json("content").alias("content"))), "linked").otherwise("repeated")
    else:
        answered = results.join(heads.select("conv_id", "id", "first", F.col("r.turn").alias("_first_turn")), ["conv_id", "id"], "left")
        state = F.when(F.col("first").isNull(), "no_call").when(F.col("turn") < F.col("first.turn"), "early").when(F.col("turn") > F.col("_first_turn"), "repeated").otherwise("linked")
    result_rows = answered.select("conv_id", "turn", F.lit(0).alias("part"), F.lit("result").alias("kind"), F.col("id").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), state.alias("status"), F.lit("").alias("errors"), F.to_json(F.struct("content", F.col("id").alias("tool_call_id"))).alias("json"))

    is_result = (F.col("role") == "tool") & _at(F.col("v"), "$.tool_call_id", "string").isNotNull()
    has_calls = (F.col("role") != "tool") & _at(F.col("v"), "$.tool_calls", "array<variant>").isNotNull()
    content = F.when(has_calls, _at(F.col("v"), "$.content", "string")).otherwise(F.col("text"))
    plain = parsed.filter(~F.coalesce(is_result, F.lit(False))).select(
        "conv_id", "turn", F.lit(-1).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(-1).alias("level"), F.lit("plain").alias("status"), F.lit("").alias("errors"), F.to_json(F.struct(content.alias("content"), "role")).alias("json")
    )
    return plain.unionByName(call_rows).unionByName(result_rows)
