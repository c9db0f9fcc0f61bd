"""Tool-call linking: calls are hash-joined with results, ordered by dependency, checked against schemas and serialised.

Everything is native SQL. Repeated identifiers are folded by aggregates that combine before they shuffle, so a hot
identifier costs one row per map task. Levels are found in rounds (Kahn): every call carries the number of its open dependencies, a round
joins only the calls of the level before with the edges still open, and calls without open ones make the next level. The rounds are as
many as the longest chain.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_scratch, scratch, table

#: Names and argument types of the calls that conversations_to_calls makes.
TURN_SCHEMAS = {
    "open": {"required": {"prompt": "string", "turn": "integer"}},
    "ask": {"required": {"prompt": "string", "turn": "integer"}, "optional": {"note": "string"}},
}
_SHAPES = {"string": "STRING", "integer": "BIGINT|INT|SMALLINT|TINYINT", "number": r"BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _errors(name: Column, args: Column, keys: Column, schemas: Mapping[str, Mapping]) -> Column:
    """Array of findings in the order: no object, unknown name, then missing, ill-typed and unexpected arguments by name."""
    none = F.array().cast("array<string>")
    out = F.array(F.concat(F.lit("unknown name "), F.coalesce(name, F.lit(""))))
    for call, schema in schemas.items():
        fields = sorted({**schema.get("required", {}), **schema.get("optional", {})}.items())
        found = []
        for field, kind in fields:
            shape = F.schema_of_variant(F.try_variant_get(args, f"$.{json.dumps([field])[1:-1]}" if not field.isidentifier() else f"$.{field}", "variant"))
            lacks = F.when(~F.array_contains(keys, field), F.lit(f"missing {field}") if field in schema.get("required", {}) else F.lit(None))
            found.append(F.coalesce(lacks, F.when(F.array_contains(keys, field) & ~F.coalesce(shape.rlike(f"^({_SHAPES[kind]})$"), F.lit(False)), F.lit(f"{field} is not {kind}"))))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f, _ in fields]) if fields else none)), lambda k: F.concat(F.lit("unexpected "), k))
        out = F.when(name == call, F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none, extra)).otherwise(out)
    return F.when(keys.isNull(), F.array(F.lit("arguments are not an object"))).otherwise(out)


def dependency_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls(conv_id, call_id, depends_on); level is 0 without dependencies, else one more than
    the highest among them. Dependencies on calls that don't exist are ignored; calls in or behind a cycle get no row."""
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on")).join(
        calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi"
    )
    edges, path = scratch(edges)
    waiting, old = scratch(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("open")))
    free = calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti")
    done = [scratch(free.withColumn("level", F.lit(0)))[0]]
    while True:
        closed = edges.join(done[-1].select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("closed"))
        left = waiting.join(closed, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"))
        left, new = scratch(left)
        drop_scratch(calls.sparkSession, old)
        old, waiting = new, left.where("open > 0")
        ready, _ = scratch(left.where("open = 0").select("conv_id", "call_id", F.lit(len(done)).alias("level")))
        if ready.isEmpty():
            drop_scratch(calls.sparkSession, old, path)
            return reduce(DataFrame.unionByName, done)
        done.append(ready)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per (conv_id, call_id) of calls(conv_id, call_id, turn, name, arguments, depends_on), with its result of
    results(conv_id, call_id, turn, content).

    Calls or results without a conversation or identifier are left out: nothing can refer to them. Of repeated calls the one with the smallest
    (turn, name, arguments) stands and repeats counts them all; of repeated results the last by (turn, content) stands. A call
    without result is kept, linked false, and so is a result without call, with no name, arguments or level, 0 repeats and that problem. Calls in or behind a cycle are kept with level null. Arguments that aren't a JSON object, null
    included, give valid false and are serialised as null. Other columns are ignored; empty tables give an empty result.
    """
    calls = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    one = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count("*").alias("repeats"))
    one, _ = scratch(one.select("conv_id", "call_id", "c.*", "repeats"))
    last = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.max(F.struct("turn", "content")).alias("r"))
    linked = one.join(last.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(dependency_levels(one), ["conv_id", "call_id"], "left")
    orphan = F.col("repeats").isNull()
    args = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    linked = linked.withColumns({"args": F.when(is_object, args), "keys": F.when(is_object, F.json_object_keys("arguments"))})
    errors = _errors(F.col("name"), F.col("args"), F.col("keys"), schemas)
    linked = linked.withColumn("errors", F.when(orphan, F.array(F.lit("result without call"))).otherwise(errors))
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("args"), F.lit("null")),
        F.lit(',"depends_on":'), F.to_json(F.coalesce(F.array_sort("depends_on"), F.array().cast("array<string>"))),
        F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("r.content")), F.lit("}"),
    )
    return linked.select(
        "conv_id", "call_id", F.coalesce("turn", "r.turn").alias("turn"), F.col("level").cast("int").alias("level"), F.coalesce("repeats", F.lit(0)).alias("repeats"), (F.col("r").isNotNull() & ~orphan).alias("linked"),
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("problems"), record.alias("record"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""), F.lit("null"))


def conversations_to_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call, every assistant turn as the result of the turn before. Calls of a conversation form a binary
    tree: the k-th depends on the (k-1)/2-th, k counting turns of the same parity. Turns whose text is empty or null make no prompt, those
    with a text of odd length a note that is a number, and those of a length divisible by 5 an argument that no schema has. Rows without
    a turn are left out."""
    rows = conversations.where(F.col("turn").isNotNull()).select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ident = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn, k, size = F.col("turn"), F.expr("turn div 2"), F.coalesce(F.length("text"), F.lit(0))
    parent = ((k - 1) / 2).cast("long") * 2 + F.pmod(turn, F.lit(2))
    calls = rows.where("role = 'user'").select(
        "conv_id", ident(turn).alias("call_id"), "turn", F.when(turn < 2, "open").otherwise("ask").alias("name"),
        F.to_json(F.struct(F.when(size > 0, F.col("text")).alias("prompt"), "turn", F.when(size % 2 == 1, size).alias("note"), F.when((size > 0) & (size % 5 == 0), "x").alias("extra"))).alias("arguments"),
        F.when(k > 0, F.array(ident(parent))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    return calls, rows.where("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_tool_calls over all conversations as calls and results; nulls, ties, repeats, empty tables and extra columns as there."""
    return link_tool_calls(*conversations_to_calls(table(spark, sf_dir, "conversations")), TURN_SCHEMAS)


ORACLE = """
WITH RECURSIVE said AS (
  SELECT conv_id, turn, text, coalesce(length(text), 0) AS n FROM conversations WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL),
made AS (
  SELECT conv_id, turn, '{' || CASE WHEN n > 0 THEN '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END || '"turn":' || turn
    || CASE WHEN n % 2 = 1 THEN ',"note":' || n ELSE '' END || CASE WHEN n > 0 AND n % 5 = 0 THEN ',"extra":"x"' ELSE '' END || '}' AS arguments,
    '{' || CASE WHEN n > 0 AND n % 5 = 0 THEN '"extra":"x",' ELSE '' END || CASE WHEN n % 2 = 1 THEN '"note":' || n || ',' ELSE '' END
    || CASE WHEN n > 0 THEN '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END || '"turn":' || turn || '}' AS canonical,
    list_filter([CASE WHEN turn >= 2 AND n % 2 = 1 THEN 'note is not string' END, CASE WHEN n = 0 THEN 'missing prompt' END,
      CASE WHEN n > 0 AND n % 5 = 0 THEN 'unexpected extra' END, CASE WHEN turn < 2 AND n % 2 = 1 THEN 'unexpected note' END], lambda x: x IS NOT NULL) AS found FROM said),
calls AS (
  SELECT conv_id, turn, arg_min(canonical, arguments) AS canonical, arg_min(found, arguments) AS found, count(*) AS repeats FROM made GROUP BY conv_id, turn),
deps AS (SELECT *, CASE WHEN turn // 2 > 0 THEN ((turn // 2 - 1) // 2) * 2 + turn % 2 END AS parent FROM calls),
levels AS (
  SELECT d.conv_id, d.turn, 0 AS level FROM deps d
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = d.conv_id AND p.turn = d.parent)
  UNION ALL
  SELECT d.conv_id, d.turn, l.level + 1 FROM deps d JOIN levels l ON l.conv_id = d.conv_id AND l.turn = d.parent),
results AS (
  SELECT conv_id, turn - 1 AS turn, arg_max(text, (turn, text)) AS content
  FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id, turn)
SELECT d.conv_id, 'call:' || d.conv_id || ':' || d.turn AS call_id, d.turn, l.level, d.repeats, r.turn IS NOT NULL AS linked,
       len(d.found) = 0 AS valid, array_to_string(d.found, '; ') AS problems,
       '{"arguments":' || d.canonical
       || ',"depends_on":' || CASE WHEN d.parent IS NULL THEN '[]' ELSE '["call:' || d.conv_id || ':' || d.parent || '"]' END
       || ',"id":"call:' || d.conv_id || ':' || d.turn || '","name":"' || CASE WHEN d.turn < 2 THEN 'open' ELSE 'ask' END
       || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS record
FROM deps d LEFT JOIN levels l USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn)
UNION ALL
SELECT r.conv_id, 'call:' || r.conv_id || ':' || r.turn, r.turn + 1, NULL, 0, false, false, 'result without call',
       '{"arguments":null,"depends_on":[],"id":"call:' || r.conv_id || ':' || r.turn || '","name":null,"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}'
FROM results r ANTI JOIN calls c USING (conv_id, turn)
"""
