"""Linking tool calls to their results, in order, validated and serialised.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object
with ``tool_calls``: objects of ``id``, ``name`` and ``arguments``, where the array
``after`` in the arguments names calls this one needs. A ``tool`` message is a JSON
object of ``tool_call_id`` and ``content``. Everything is joins, aggregations and
built-in functions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.tables import stored

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: calls of a conversation that are numbered together
ORDER_RANGE = 256

#: JSON types of an argument by the start of a variant's type
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}

#: name -> argument -> (type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, pos, call_id, name, arguments (JSON text), one row a call."""
    parsed = F.from_json("text", _CALLS)["tool_calls"]
    return (
        messages.where("role = 'assistant'")
        .select("conv_id", "turn", F.posexplode(parsed).alias("pos", "call"))
        .select(
            "conv_id", "turn", "pos",
            F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), "call.arguments",
        )
    )


def results_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content: one row a tool message."""
    parsed = F.from_json("text", _RESULT)
    return messages.where("role = 'tool'").select(
        "conv_id", "turn", parsed["tool_call_id"].alias("call_id"), parsed["content"].alias("content")
    )


# -------------------------------------------------------------------------- validation


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as a sorted array of words.

    ``unknown_tool``, ``not_an_object``, and ``missing:x``, ``type:x``, ``unknown:x`` for
    an argument x. A JSON null counts as missing. ``after`` (an array) is always known.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        known = {"after": ("array", False)} | fields
        checks = []
        for field, (kind, required) in sorted(known.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            absent = got.isNull() | (got == "VOID")
            right = reduce(lambda a, b: a | b, [got.startswith(t) for t in TYPES[kind]])
            missing = F.lit(f"missing:{field}") if required else F.lit(None).cast("string")
            checks.append(F.when(absent, missing).when(~right, F.lit(f"type:{field}")))
        unknown = F.transform(
            F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(known)))),
            lambda k: F.concat(F.lit("unknown:"), k),
        )
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)), F.coalesce(unknown, F.array())))
        verdict = F.when(is_object, found).otherwise(F.array(F.lit("not_an_object")))
        out = F.when(name == tool, verdict).otherwise(out)
    return out


def canonical(arguments: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it is not JSON."""
    return F.to_json(F.try_parse_json(arguments))


# ---------------------------------------------------------------------- topological order


def topological_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage, hops, cyclic) for calls with unique ids.

    A call's stage is the latest place (turn, then position) of itself and all calls it
    needs, and its hops the longest way down from a call that stands there; so sorting by
    stage, hops and place puts every call behind those it needs. Where calls only need
    earlier ones, stage is their own place and nothing is iterated; each round follows
    one more step of the needs that point forward. Calls on a cycle, and behind one
    within their stage, are cyclic.
    """
    at = (F.col("turn").cast("long") * (1 << 20) + F.col("pos")).alias("at")
    nodes = stored(calls.select("conv_id", "call_id", at, "arguments"), "nodes")
    wanted = F.from_json("arguments", "struct<after:array<string>>")["after"]
    needs = (
        nodes.select("conv_id", F.col("call_id").alias("child"), F.col("at").alias("child_at"), F.explode(wanted).alias("parent"))
        .where("parent is not null")
        .distinct()
    )
    parents = nodes.select("conv_id", F.col("call_id").alias("parent"), F.col("at").alias("parent_at"))
    edges = stored(needs.join(parents, ["conv_id", "parent"]), "needs")
    keys = nodes.select("conv_id", "call_id", "at", F.col("at").alias("stage"), F.lit(0).cast("long").alias("hops"))
    late = edges.where("parent_at >= child_at")
    moved = late.groupBy("conv_id", F.col("child").alias("call_id")).agg(
        F.max(F.struct(F.col("parent_at").alias("stage"), F.lit(1).cast("long").alias("hops"))).alias("new")
    )
    if late.isEmpty():
        return keys.withColumn("cyclic", F.lit(False)).drop("at")
    size = stored(nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    while True:
        # a way of more steps than there are calls goes round; twice as many are followed
        # so that every call on the round gets that far
        keys = stored(
            keys.join(moved, ["conv_id", "call_id"], "left")
            .withColumn("old", F.struct("stage", "hops"))
            .withColumn("changed", F.coalesce(F.col("new") > F.col("old"), F.lit(False)))
            .withColumn("top", F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")))
            .select("conv_id", "call_id", "at", "top.stage", "top.hops", "changed"),
            "keys",
        )
        fresh = keys.where("changed").join(size, "conv_id").where("hops <= 2 * size").select(
            "conv_id", F.col("call_id").alias("parent"), "stage", "hops"
        )
        if fresh.isEmpty():
            break
        moved = (
            fresh.join(edges, ["conv_id", "parent"])
            .where("stage >= child_at")
            .groupBy("conv_id", F.col("child").alias("call_id"))
            .agg(F.max(F.struct("stage", (F.col("hops") + 1).alias("hops"))).alias("new"))
        )
        keys = keys.drop("changed")
    return keys.join(size, "conv_id").select(
        "conv_id", "call_id", "stage", "hops", (F.col("hops") > F.col("size")).alias("cyclic")
    )


def numbered(keyed: DataFrame, order: list[str], name: str) -> DataFrame:
    """``keyed`` with the place of each row in its conversation, from 0.

    Places are counted within ranges of turns and added up over ranges, so that a very
    long conversation is many groups.
    """
    ranged = keyed.withColumn("range_", F.floor(F.shiftright("stage", 20) / ORDER_RANGE))
    counts = ranged.groupBy("conv_id", "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("conv_id").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "conv_id", "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_")
    )
    own = ranged.alias("r").join(
        starts.alias("s"),
        F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("r.range_").eqNullSafe(F.col("s.range_")),
    ).select("r.*", "s.start_")
    within = Window.partitionBy("conv_id", "range_").orderBy(*order)
    place = F.col("start_") + F.row_number().over(within) - 1
    return own.withColumn(name, place.cast("long")).drop("range_", "start_")


# -------------------------------------------------------------------------- operator


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: conv_id, call_id, name, turn, position (topological, from 0),
    result_turn, n_results, status, errors and canonical.

    Calls and results meet by a hash join on (conv_id, call_id). The first call of an id
    (by turn and place in the message) owns it, later ones are ``duplicate``; the first
    result at or after it is linked, others only count. ``status`` is the first that
    holds of ``no_id`` (null id), ``duplicate``, ``cycle`` (it needs itself), ``invalid``
    (``errors`` says why), ``unanswered`` and ``linked``. ``canonical`` is the call as
    JSON with sorted keys: arguments, id, name, result. Messages that are no JSON, and
    results without a call, give no rows. Nulls in conv_id are one conversation. Rows
    that repeat are calls that repeat. Other columns are not read.
    """
    plain = messages.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"), "role", "text"
    )
    # a null conversation takes part under a key of its own
    keyed = plain.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("\u0000")))
    as_key = keyed.select(F.col("conv").alias("conv_id"), "turn", "role", "text")
    names = keyed.select(F.col("conv").alias("key_"), F.col("conv_id").alias("conv_")).distinct()
    calls = stored(calls_of(as_key), "calls")
    results = results_of(as_key).where("call_id is not null")
    owned = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "pos", "name", "arguments")).alias("first"), F.count(F.lit(1)).alias("n_calls")
    )
    owners = stored(owned.select("conv_id", "call_id", "first.*", "n_calls"), "owners")
    answers = (
        results.withColumnRenamed("turn", "result_turn")
        .join(owners.select("conv_id", "call_id", "turn").hint("shuffle_hash"), ["conv_id", "call_id"])
        .groupBy("conv_id", "call_id")
        .agg(
            F.min(F.when(F.col("result_turn") >= F.col("turn"), F.struct("result_turn", "content"))).alias("answer"),
            F.count(F.lit(1)).alias("n_results"),
        )
    )
    linked = owners.join(topological_keys(owners), ["conv_id", "call_id"]).join(
        answers, ["conv_id", "call_id"], "left"
    )
    place = [F.col("turn") * (1 << 20) + F.col("pos")]
    copies = calls.join(
        owners.select("conv_id", "call_id", F.col("turn").alias("turn_"), F.col("pos").alias("pos_")),
        ["conv_id", "call_id"],
        "left",
    ).where("call_id is null or turn != turn_ or pos != pos_")
    rest = copies.select(
        "conv_id", "call_id", "turn", "pos", "name", "arguments",
        place[0].alias("stage"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("cyclic"),
        F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("string").alias("content"),
        F.lit(0).cast("long").alias("n_results"),
        F.when(F.col("call_id").isNull(), "no_id").otherwise("duplicate").alias("given"),
    )
    firsts = linked.select(
        "conv_id", "call_id", "turn", "pos", "name", "arguments", "stage", "hops", "cyclic",
        F.col("answer.result_turn").alias("result_turn"), F.col("answer.content").alias("content"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.lit(None).cast("string").alias("given"),
    )
    placed = numbered(firsts.unionByName(rest), ["stage", "hops", "turn", "pos"], "position")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    status = (
        F.when(F.col("given").isNotNull(), F.col("given"))
        .when(F.col("cyclic"), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_turn").isNull(), "unanswered")
        .otherwise("linked")
    )
    # members in the order of their names; nulls are written
    member = lambda key, value: F.concat(F.lit(f'"{key}":'), F.coalesce(value, F.lit("null")))
    quoted = lambda c: F.to_json(F.col(c).cast("variant"))
    text = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("arguments", canonical(F.col("arguments"))),
            member("id", quoted("call_id")),
            member("name", quoted("name")),
            member("result", quoted("content")),
        ),
        F.lit("}"),
    )
    out = placed.withColumn("errors", errors).withColumn("status", status).withColumn("canonical", text)
    return out.join(names, F.col("conv_id") == F.col("key_")).select(
        F.col("conv_").alias("conv_id"), "call_id", "name", "turn", "position", "result_turn",
        "n_results", "status", "errors", "canonical",
    )
