"""Tool calls linked to their results, ordered, validated and written as canonical JSON; built-in functions only.

Calls are (conv, turn, call_id, name, arguments, depends_on), results are (conv, turn, call_id, content). A call and its results meet
in a hash join on (conv, call_id); results are first reduced to one row per identifier (the earliest, and how many there were),
so neither a repeated identifier nor a conversation of any length multiplies or gathers rows.

Order: a call comes after all calls it depends on. A call whose dependencies all stand in earlier turns keeps its turn; only a
call that depends on a later turn is moved behind it, and what depends on it in turn. ``after_turn, hops`` sorts a conversation
topologically (ties by turn, call_id). Calls on a cycle, or behind one, get no position and the error ``cycle``.

Errors, in fixed order: ``no id``, ``repeated id`` (a later call of the same id), ``unknown tool``, ``bad json``, ``missing: f``,
``type: f``, ``extra: f``, ``missing dependency``, ``cycle``, ``no result``. Null columns count as absent; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.tables import stage

#: Kinds of argument, and what the parser calls them.
TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*$", "object": "^OBJECT<.*$",
}
#: Tool name to field to (kind, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Errors of a call's arguments against its tool's schema, in order of the fields."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
            missing = F.lit(f"missing: {field}") if required else F.lit(None).cast("string")
            checks.append(F.when(absent, missing).when(~F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(f"type: {field}")))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.expr("cast(array() as array<string>)")
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), known)), lambda k: F.concat(F.lit("extra: "), k))
        found = F.concat(F.array_compact(F.array(*checks)) if checks else F.expr("cast(array() as array<string>)"), extra)
        out = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("bad json")))).otherwise(out)
    return out


def positions(calls: DataFrame) -> DataFrame:
    """(conv, call_id, after_turn, hops, cycle) per distinct identifier."""
    own = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min("turn").alias("turn"), F.flatten(F.collect_set("depends_on")).alias("needs"))
    own, _ = stage(own, "calls")
    edges = own.select("conv", F.col("call_id").alias("later"), F.explode("needs").alias("call_id"))
    edges, _ = stage(edges.join(own.select("conv", "call_id"), ["conv", "call_id"], "left_semi").distinct(), "needs")
    state = own.select("conv", "call_id", F.struct(F.col("turn").alias("at"), F.lit(0).alias("hops")).alias("key"))
    start, changed = state, state
    moved = None
    while True:
        behind = edges.join(changed, ["conv", "call_id"]).select(
            "conv", F.col("later").alias("call_id"), F.struct(F.col("key.at").alias("at"), (F.col("key.hops") + 1).alias("hops")).alias("new")
        ).groupBy("conv", "call_id").agg(F.max("new").alias("new"))
        current = state if moved is None else start.join(
            moved.select("conv", "call_id", F.col("key").alias("moved")), ["conv", "call_id"], "left"
        ).select("conv", "call_id", F.coalesce("moved", "key").alias("key"))
        # an equal turn is a position before its dependency too
        raised = behind.join(current, ["conv", "call_id"]).where("new.at > key.at or (new.at = key.at and new.hops > key.hops)")
        changed, _ = stage(raised.select("conv", "call_id", F.col("new").alias("key")), "moved")
        if changed.isEmpty():
            break
        merged = changed if moved is None else moved.join(changed.select("conv", "call_id"), ["conv", "call_id"], "left_anti").unionByName(changed)
        moved, _ = stage(merged, "positions")
        # a path through moved calls visits each at most once: more hops than moved calls means a cycle
        size = moved.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
        looping = moved.join(size, "conv").where("key.hops > n")
        changed = changed.join(looping.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    if moved is None:
        return own.select("conv", "call_id", F.col("turn").alias("after_turn"), F.lit(0).alias("hops"), F.lit(False).alias("cycle"))
    size = moved.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    bad = moved.join(size, "conv").where("key.hops > n").select("conv", "call_id")
    frontier = bad
    while True:  # what depends on a cycle has no position either
        more, _ = stage(edges.join(frontier, ["conv", "call_id"]).select("conv", F.col("later").alias("call_id")).distinct().join(bad, ["conv", "call_id"], "left_anti"), "behind")
        if more.isEmpty():
            break
        bad, _ = stage(bad.unionByName(more), "cycles")
        frontier = more
    out = own.select("conv", "call_id", "turn").join(moved, ["conv", "call_id"], "left").join(
        bad.select("conv", "call_id", F.lit(True).alias("cycle")), ["conv", "call_id"], "left"
    )
    cycle = F.coalesce("cycle", F.lit(False))
    return out.select(
        "conv", "call_id", F.when(~cycle, F.coalesce("key.at", "turn")).alias("after_turn"),
        F.when(~cycle, F.coalesce("key.hops", F.lit(0))).alias("hops"), cycle.alias("cycle"),
    )


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Per call: conv, turn, call_id, after_turn, hops, n_results, errors, json (the canonical record)."""
    calls = calls.select("conv", "turn", "call_id", "name", "arguments", "depends_on")
    answer = results.where("call_id is not null").groupBy("conv", "call_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.min_by("content", F.struct("turn", "content")).alias("content")
    )
    placed = positions(calls)
    first = calls.groupBy("conv", "call_id").agg(F.min("turn").alias("first_turn"))
    needs = calls.where("size(depends_on) > 0 and call_id is not null").select("conv", "call_id", F.explode(F.array_distinct("depends_on")).alias("need"))
    absent = needs.join(calls.select("conv", F.col("call_id").alias("need")).distinct(), ["conv", "need"], "left_anti").select("conv", "call_id").distinct()
    keys = ["conv", "call_id"]
    joined = (
        calls.join(answer, keys, "left").join(placed, keys, "left").join(first, keys, "left")
        .join(absent.withColumn("absent", F.lit(True)), keys, "left")
    )
    said = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.expr("cast(array() as array<string>)"))
    nothing = F.expr("cast(array() as array<string>)")
    errors = F.concat(
        said(F.col("call_id").isNull(), "no id"), said(F.col("turn") > F.col("first_turn"), "repeated id"),
        F.coalesce(argument_errors(F.col("name"), F.col("arguments"), schemas), nothing),
        said(F.col("absent").isNotNull(), "missing dependency"), said(F.coalesce("cycle", F.lit(False)), "cycle"),
        said(F.col("n_results").isNull(), "no result"),
    )
    record = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), "call_id", F.array_sort("depends_on").alias("depends_on"), "name",
            F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return joined.select(
        "conv", "turn", "call_id", "after_turn", "hops", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        errors.alias("errors"), record.alias("json"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results without a call."""
    return results.join(calls.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
