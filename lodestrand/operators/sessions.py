"""Sessions from events: snapshot merge, metadata, messages and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.paths import canonical, canonical_text
from lodestrand.sources.transcripts import once

SYNTHETIC_MODEL = "<synthetic>"
POSITION = ("source_rank", "line_no")


def _ord() -> Column:
    return F.struct(*POSITION)


def merge_snapshots(events: DataFrame) -> DataFrame:
    """One event per (session_id, uuid), the oldest snapshot's first; events without uuid all stay. in_order() sorts them, for a sink."""
    named = events.where("uuid IS NOT NULL")
    first = Window.partitionBy("session_id", "uuid").orderBy(*POSITION)
    kept = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.unionByName(events.where("uuid IS NULL"))


def in_order(events: DataFrame) -> DataFrame:
    """Merged events as they are written: by session, then timestamp text, nulls last."""
    return events.orderBy("session_id", F.asc_nulls_last("ts_raw"), *POSITION)


def conversation(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin("user", "assistant") & ~F.col("is_sidechain"))


def session_metadata(events: DataFrame) -> DataFrame:
    """session_id, cwd (first), started_at, ended_at, model (last real), token sums over all assistants, event_count."""
    tokens = lambda f: F.coalesce(F.try_variant_get("usage", f"$.{f}", "bigint"), F.lit(0))
    counted = lambda f: F.sum(F.when((F.col("type") == "assistant") & (tokens(f) > 0), tokens(f)).otherwise(0))
    real = (F.col("type") == "assistant") & F.col("model").isNotNull() & (F.col("model") != SYNTHETIC_MODEL)
    return events.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), _ord())).alias("cwd"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.max_by("model", F.when(real, _ord())).alias("model"), counted("input_tokens").alias("input_tokens"), counted("output_tokens").alias("output_tokens"), F.count("*").alias("event_count"),
    )


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, name: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind, F.lit(False))


def _present(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant").isNotNull()


def _optional(v: Column, name: str, kind: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return found.isNull() | found.isin(kind, "VOID")


def blocks_of(content: Column) -> Column:
    """Content blocks of an array, or an empty array if any of them isn't well-formed: one bad block empties the message."""
    items = F.try_variant_get(content, "$", "array<variant>")
    good = lambda v: (
        F.when(_field(v, "type") == "text", _is(v, "text", "STRING"))
        .when(_field(v, "type") == "thinking", _is(v, "thinking", "STRING") & _optional(v, "signature", "STRING"))
        .when(_field(v, "type") == "tool_use", _is(v, "id", "STRING") & _is(v, "name", "STRING") & _present(v, "input") & _optional(v, "caller", "STRING"))
        .when(_field(v, "type") == "tool_result", _is(v, "tool_use_id", "STRING") & _present(v, "content") & _optional(v, "is_error", "BOOLEAN"))
        .otherwise(False)
    )
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(F.forall(items, lambda v: F.coalesce(good(v), F.lit(False))), items), none)


def plain_text(content: Column, blocks: Column) -> Column:
    """A bare string as it is, else the text blocks with a blank line between."""
    texts = F.transform(F.filter(blocks, lambda v: _field(v, "type") == "text"), lambda v: _field(v, "text"))
    bare = (F.size(blocks) == 0) & (F.schema_of_variant(content) == "STRING")
    return F.when(bare, F.try_variant_get(content, "$", "string")).otherwise(F.array_join(texts, "\n\n"))


def result_text(v: Column) -> Column:
    """A tool result as text: strings as they are; of an array, texts of text items and JSON of others, by lines; else JSON."""
    items = F.try_variant_get(v, "$", "array<variant>")
    parts = F.transform(items, lambda x: F.when(_field(x, "type") == "text", F.when(_is(x, "text", "STRING"), _field(x, "text"))).otherwise(F.to_json(x)))
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")).otherwise(F.to_json(v))


def reconstruct(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, tool_calls): user and assistant turns outside side chains, and the assistants' tool uses with their results.

    A result may come before or after its use; of several with one id the last stands. Messages without text and calls are left out.
    """
    turns = once(conversation(events).select("session_id", *POSITION, "type", "content"), blocks=blocks_of(F.col("content")))
    called = F.exists("blocks", lambda v: _field(v, "type") == "tool_use") & (F.col("type") == "assistant")
    spoken = once(turns, text=F.coalesce(plain_text(F.col("content"), F.col("blocks")), F.lit("")), called=called)
    messages = spoken.where((F.col("text") != "") | F.col("called")).select("session_id", *POSITION, F.col("type").alias("role"), F.col("text").alias("content"))

    # Uses and results of one id meet in one shuffle; call_ord counts a message's uses.
    wanted = F.when(F.col("type") == "assistant", "tool_use").otherwise("tool_result")
    parts = turns.select("session_id", *POSITION, "type", wanted.alias("wanted"), "blocks")
    parts = parts.select("session_id", *POSITION, "type", F.posexplode(F.filter("blocks", lambda v: _field(v, "type") == F.col("wanted"))).alias("nth", "v"))
    use, v = F.col("type") == "assistant", F.col("v")
    parts = parts.select(
        "session_id", *POSITION, F.col("nth").alias("call_ord"), use.alias("use"), F.when(use, _field(v, "id")).otherwise(_field(v, "tool_use_id")).alias("tool_use_id"),
        F.when(use, _field(v, "name")).alias("name"), F.when(use, F.to_json(_field(v, "input", "variant"))).alias("input"), F.when(~use, result_text(_field(v, "content", "variant"))).alias("output"),
    )
    last = F.max(F.when(~F.col("use"), F.struct(*POSITION, "call_ord", "output"))).over(Window.partitionBy("session_id", "tool_use_id"))
    calls = parts.withColumn("output", last["output"]).where("use").drop("use")
    return messages, calls.select("session_id", *POSITION, "call_ord", "tool_use_id", "name", "input", "output")


def skip_reason(sessions: DataFrame, skips: list[str]) -> DataFrame:
    """sessions with skip_path: the first entry of skips that is the cwd or one of its parent folders, or null."""
    out = F.lit(None).cast("string")
    for path in reversed(skips):
        parent = path.rstrip("/") + "/"
        out = F.when((F.col("cwd") == path) | F.col("cwd").startswith(parent) | (F.concat(F.col("cwd"), F.lit("/")) == parent), path).otherwise(out)
    return sessions.withColumn("skip_path", out)


def skip_canonical(sessions: DataFrame, skips: list[str]) -> DataFrame:
    """skip_reason() by canonical paths on either side; cwd stays as it was said."""
    rows = sessions.withColumns({"said": F.col("cwd"), "cwd": canonical("cwd")})
    return skip_reason(rows, [canonical_text(p) for p in skips]).withColumn("cwd", F.col("said")).drop("said")


def pair_last_wins(uses: DataFrame, results: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """uses left-joined with the last result of their key."""
    return uses.join(results.groupBy(*key).agg(F.max_by(value, order).alias(value)), key, "left")
