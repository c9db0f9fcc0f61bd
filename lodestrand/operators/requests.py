"""Requests to an external text model, and its responses."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import ASSISTANT_CAP, TOOL_INPUT_CAP, TOOL_OUTPUT_CAP, USER_CAP, PageFormat, json_object_in, truncate_bytes, unfence
from lodestrand.sources.pages import KIND_DIRS
from lodestrand.sources.runs import Template
from lodestrand.sources.transcripts import once

_RELATIONS = "uses array<string>, `used-by` array<string>, related array<string>, supersedes array<string>"


def capped_messages(messages: DataFrame) -> DataFrame:
    """messages with content within the byte cap of its role."""
    return messages.withColumn("content", F.when(F.col("role") == "assistant", truncate_bytes("content", ASSISTANT_CAP)).otherwise(truncate_bytes("content", USER_CAP)))


def capped_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumns({"input": truncate_bytes("input", TOOL_INPUT_CAP), "output": truncate_bytes("output", TOOL_OUTPUT_CAP)})


def render_topics(topics: DataFrame) -> DataFrame:
    """One row (existing_topics, existing_topics_count): topics by kind, then slug."""
    line = F.concat(F.lit("- `"), "slug", F.lit("` — "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit("")), F.lit("\n"))
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind_dir") == k, F.struct("slug", line.alias("line"))))), lambda x: x.line), "")
    one = topics.agg(part("concepts").alias("c"), part("entities").alias("e"), F.count("*").alias("n"))
    c, e = F.when(F.col("c") != "", F.concat(F.lit("Concepts:\n"), "c")).otherwise(""), F.when(F.col("e") != "", F.concat(F.lit("Entities:\n"), "e")).otherwise("")
    gap = F.when((F.col("c") != "") & (F.col("e") != ""), "\n").otherwise("")
    return one.select(F.concat(c, gap, e).alias("existing_topics"), F.col("n").alias("existing_topics_count"))


def render_transcripts(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, transcript): capped messages in order, each with its tool calls."""
    order = ["session_id", "source_rank", "line_no"]
    call = F.concat(F.lit("  tool "), "name", F.lit(" "), F.coalesce("input", F.lit("{}")), F.when(F.col("output").isNotNull(), F.concat(F.lit(" -> "), "output")).otherwise(""), F.lit("\n"))
    called = capped_calls(calls).groupBy(*order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_ord", call.alias("line")))), lambda x: x.line), "").alias("tools"))
    text = F.concat(F.lit("["), "role", F.lit("] "), "content", F.lit("\n"), F.coalesce("tools", F.lit("")))
    rows = capped_messages(messages).join(called, order, "left").select(*order, text.alias("text"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "line_no", "text"))), lambda x: x.text), "\n").alias("transcript"))


_MARK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TAG = re.compile(r"\{%-?\s*(if|elif|else|endif|for|endfor)\b\s*(.*?)\s*-?%\}", re.S)
_TEST = re.compile(r"(not\s+)?([\w.]+)\s*(?:\|\s*(length)\s*)?(?:(==|!=|<=|>=|<|>)\s*(.+))?")


#: What a loop's body knows of its place in the list.
_LOOP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("index", "index0", "length")] + [T.StructField(n, T.BooleanType()) for n in ("first", "last")])


def _loop(inside: Column, i: Column) -> dict[str, Column]:
    n = F.size(inside)
    return {"index": i + 1, "index0": i, "length": n, "first": i == 0, "last": i == n - 1}


def _typed(c: dict[str, Column], kinds: dict[str, T.DataType], path: str) -> tuple[Column, T.DataType]:
    """A dotted name as a column, and its type; an error for one that isn't there."""
    first, *rest = path.split(".")
    if first not in kinds:
        raise ValueError(f"template: unknown name {path}")
    column, kind = c[first], kinds[first]
    for field in rest:
        if not isinstance(kind, T.StructType) or field not in kind.names:
            raise ValueError(f"template: unknown name {path}")
        column, kind = column[field], kind[field].dataType
    return column, kind


class TextTemplate:
    """A text template as one native expression: {{ name }}, {{ name | length }}, if / elif / else / endif and for / endfor, with
    dotted names, in loops also loop.index, .index0, .first, .last and .length. Null is empty text; empty text, empty lists, 0 and false count as
    false. A name that isn't there is an error. One newline at the end is dropped."""

    def __init__(self, source: str):
        self.parts, rest = self._read(_MARK.split(source.removesuffix("\n")), ())
        if rest:
            raise ValueError(f"template: {rest[0]} without its beginning")

    def _read(self, parts: list[str], until: tuple[str, ...]) -> tuple[list, list[str]]:
        out: list = []
        while parts:
            part, parts = parts[0], parts[1:]
            if part.startswith("{{"):
                name, _, filtered = (x.strip() for x in part[2:-2].partition("|"))
                if filtered not in ("", "length"):
                    raise ValueError(f"template: unknown filter {filtered}")
                out.append(("value", name, filtered))
                continue
            tag = _TAG.fullmatch(part)
            if not part.startswith("{%"):
                out.append(("text", part))
            elif tag is None:
                raise ValueError(f"template: unknown tag {part}")
            elif tag[1] in until:
                return out, [part, *parts]
            elif tag[1] == "for":
                name, inside = re.split(r"\s+in\s+", tag[2])
                body, parts = self._read(parts, ("endfor",))
                out.append(("for", name, inside, body))
                parts = parts[1:]
            elif tag[1] == "if":
                branches, test = [], tag[2]
                while True:
                    body, parts = self._read(parts, ("elif", "else", "endif"))
                    branches.append((test, body))
                    if not parts:
                        raise ValueError("template: if without endif")
                    end, parts = _TAG.fullmatch(parts[0]), parts[1:]
                    if end[1] == "endif":
                        break
                    test = end[2] if end[1] == "elif" else None
                out.append(("if", branches))
            else:
                return out, [part, *parts]
        if until:
            raise ValueError(f"template: no {until[-1]}")
        return out, []

    def render(self, **values: tuple[Column, T.DataType]) -> Column:
        return self._text(self.parts, {k: v for k, (v, _) in values.items()}, {k: t for k, (_, t) in values.items()})

    def _text(self, parts: list, names: dict[str, Column], kinds: dict[str, T.DataType]) -> Column:
        out = [F.lit("")]
        for kind, *rest in parts:
            if kind == "text":
                out.append(F.lit(rest[0]))
            elif kind == "value":
                column, of = _typed(names, kinds, rest[0])
                shown = (F.size(column) if isinstance(of, T.ArrayType) else F.length(column)) if rest[1] else column
                out.append(F.coalesce(shown.cast("string"), F.lit("")))
            elif kind == "for":
                name, inside, body = rest
                column, of = _typed(names, kinds, inside)
                if isinstance(of, T.ArrayType):
                    out.append(F.coalesce(F.array_join(F.transform(column, self._body(name, column, body, names, kinds | {name: of.elementType, "loop": _LOOP})), ""), F.lit("")))
            else:
                chosen = F.lit("")
                for test, body in reversed(rest[0]):
                    text = self._text(body, names, kinds)
                    chosen = text if test is None else F.when(self._holds(test, names, kinds), text).otherwise(chosen)
                out.append(chosen)
        return F.concat(*out)

    def _body(self, name: str, inside: Column, body: list, names: dict, kinds: dict[str, T.DataType]) -> Callable[[Column, Column], Column]:
        return lambda x, i: self._text(body, names | {name: x, "loop": _loop(inside, i)}, kinds)

    def _holds(self, test: str, names: dict[str, Column], kinds: dict[str, T.DataType]) -> Column:
        found = _TEST.fullmatch(test.strip())
        if found is None:
            raise ValueError(f"template: unknown test {test}")
        negated, path, length, sign, literal = found.groups()
        column, of = _typed(names, kinds, path)
        if length:
            column, of = F.size(column) if isinstance(of, T.ArrayType) else F.length(column), T.IntegerType()
        if sign:
            value = literal.strip()
            other = F.lit(value[1:-1]) if value[:1] in "\"'" else F.lit(json.loads(value))
            holds = {"==": column == other, "!=": column != other, "<": column < other, "<=": column <= other, ">": column > other, ">=": column >= other}[sign]
        elif isinstance(of, T.ArrayType):
            holds = F.size(column) > 0
        elif isinstance(of, T.StringType):
            holds = column != ""
        elif isinstance(of, T.BooleanType):
            holds = column
        elif isinstance(of, T.NumericType):
            holds = column != 0
        else:
            holds = column.isNotNull()
        holds = F.coalesce(holds, F.lit(False))
        return ~holds if negated else holds


def session_values(metadata: DataFrame, messages: DataFrame, calls: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(session_id, transcript): what templates know of a session, transcript.session_id, .metadata and .messages, each message with
    role, content and its tool_calls (name, input, output), all within the byte caps."""
    cap = {"user_message": USER_CAP, "assistant_message": ASSISTANT_CAP, "tool_use": TOOL_INPUT_CAP, "tool_result": TOOL_OUTPUT_CAP} | (caps or {})
    order = ["session_id", "source_rank", "line_no"]
    call = F.struct("call_ord", "name", truncate_bytes(F.coalesce("input", F.lit("{}")), cap["tool_use"]).alias("input"), truncate_bytes("output", cap["tool_result"]).alias("output"))
    called = calls.groupBy(*order).agg(F.transform(F.array_sort(F.collect_list(call)), lambda x: F.struct(x["name"].alias("name"), x["input"].alias("input"), x["output"].alias("output"))).alias("tool_calls"))
    content = F.when(F.col("role") == "assistant", truncate_bytes("content", cap["assistant_message"])).otherwise(truncate_bytes("content", cap["user_message"]))
    rows = messages.select(*order, "role", content.alias("content")).join(called, order, "left")
    none = F.from_json(F.lit("[]"), "array<struct<name: string, input: string, output: string>>")
    each = F.struct("source_rank", "line_no", F.struct("role", "content", F.coalesce("tool_calls", none).alias("tool_calls")).alias("m"))
    said = rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["m"]).alias("messages"))
    about = metadata.select("session_id", F.struct(*[c for c in metadata.columns if c != "session_id"]).alias("metadata"))
    return said.join(about, "session_id", "left").select("session_id", F.struct("session_id", "metadata", "messages").alias("transcript"))


def build_requests(transcripts: DataFrame, topics: DataFrame, system: str, user_template: str, model: str, max_tokens: int, op: str = "distil", **constants) -> DataFrame:
    """(request_id, op, session_id, system, user, model, max_tokens): every session of transcripts(session_id, transcript) with all topics, which
    are one row. transcript is a text, or a struct as session_values() gives it; constants are further names of the template."""
    rows = transcripts.crossJoin(render_topics(topics))  # one row, whatever its size
    known = {c: (F.col(c), rows.schema[c].dataType) for c in ("transcript", "existing_topics", "existing_topics_count")}
    kind = {str: T.StringType(), int: T.LongType(), bool: T.BooleanType(), type(None): T.StringType()}
    known |= {k: (F.lit(v).cast(kind[type(v)]), kind[type(v)]) for k, v in constants.items()}
    user = TextTemplate(user_template).render(**known)
    made = rows.select(F.lit(op).alias("op"), "session_id", F.lit(system).alias("system"), user.alias("user"), F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"))
    return made.select(F.sha2(F.concat_ws("\0", "op", "system", "user", "model"), 256).alias("request_id"), "*")


def _requests(rows: DataFrame, op: str, key: list[str], template: Template, **names: T.DataType) -> DataFrame:
    """(request_id, op, key columns, system, user, model, max_tokens) of rows with a column for each name of the template."""
    user = TextTemplate(template.user).render(**{n: (F.col(n), kind) for n, kind in names.items()})
    made = rows.select(F.lit(op).alias("op"), *key, F.lit(template.system).alias("system"), user.alias("user"), F.lit(template.model or "").alias("model"), F.lit(template.max_tokens).alias("max_tokens"))
    return made.select(F.sha2(F.concat_ws("\0", "op", "system", "user", "model"), 256).alias("request_id"), "*")


PAIR = ["kind_a", "slug_a", "kind_b", "slug_b"]


def lint_requests(pairs: DataFrame, pages: DataFrame, template: Template) -> DataFrame:
    """A request for each of pairs(kind_a, slug_a, kind_b, slug_b, title_a, title_b) whose pages(kind_dir, slug, text) are both there, with their whole
    texts, front-matter included.

    Pairs travel as keys and sizes first. Then the shorter text of a pair comes to it, and goes with it to the longer one, which is moved
    once however many pairs its page is in. Keys of pages are distinct.
    """
    key = ["kind_dir", "slug"]
    sizes = pages.select(*key, F.octet_length("text").alias("size"))
    side = lambda df, x, **more: df.withColumnsRenamed({"kind_dir": f"kind_{x}", "slug": f"slug_{x}"} | {c: n for c, n in more.items()})
    sized = pairs.select(*PAIR, "title_a", "title_b").join(side(sizes, "a", size="size_a"), ["kind_a", "slug_a"]).join(side(sizes, "b", size="size_b"), ["kind_b", "slug_b"])
    end = lambda x: F.struct(F.col(f"kind_{x}").alias("kind_dir"), F.col(f"slug_{x}").alias("slug"))
    a_first = F.col("size_a") <= F.col("size_b")
    ends = sized.select(*PAIR, "title_a", "title_b", a_first.alias("a_first"), F.when(a_first, end("a")).otherwise(end("b")).alias("short"), F.when(a_first, end("b")).otherwise(end("a")).alias("long"))
    text = lambda name: pages.select(F.struct(*key).alias(name), F.col("text").alias(f"{name}_text"))
    both = ends.join(text("short"), "short").join(text("long"), "long")
    rows = both.select(*PAIR, "title_a", "title_b", F.when(F.col("a_first"), F.col("short_text")).otherwise(F.col("long_text")).alias("body_a"), F.when(F.col("a_first"), F.col("long_text")).otherwise(F.col("short_text")).alias("body_b"))
    return _requests(rows, "lint", PAIR, template, **dict.fromkeys(("slug_a", "slug_b", "title_a", "title_b", "body_a", "body_b"), T.StringType()))


def audit_requests(pages: DataFrame, template: Template) -> DataFrame:
    """A request for each of pages(kind_dir, slug, title, body); page_type is its folder."""
    rows = pages.withColumn("page_type", F.col("kind_dir"))
    return _requests(rows, "audit", ["kind_dir", "slug"], template, **dict.fromkeys(("slug", "title", "page_type", "body"), T.StringType()))


def consolidate_requests(pages: DataFrame, template: Template, fmt: PageFormat = PageFormat()) -> DataFrame:
    """A request for each of pages(kind_dir, slug, title, body) of two blocks and more, with the texts of all its blocks."""
    rows = pages.withColumnRenamed("title", "page_title").withColumn("fragments", fmt.blocks("body")).where(F.size("fragments") >= 2)
    rows = rows.withColumn("fragments", F.transform("fragments", lambda b: b["body"]))
    return _requests(rows, "consolidate", ["kind_dir", "slug"], template, page_title=T.StringType(), fragments=T.ArrayType(T.StringType()))


def rewrite_requests(pages: DataFrame, template: Template, fmt: PageFormat = PageFormat()) -> DataFrame:
    """A request for each of pages(kind_dir, slug, title, body) with a block; body is the text of the first."""
    rows = pages.withColumn("body", F.get(fmt.blocks("body"), F.lit(0))["body"]).where("body IS NOT NULL")
    return _requests(rows, "rewrite", ["kind_dir", "slug"], template, **dict.fromkeys(("slug", "title", "body"), T.StringType()))


def recorded_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests with the text and usage recorded for them; null where there is none."""
    return requests.join(responses, "request_id", "left")


def complete(requests: DataFrame, provider: Callable[[str, str], str]) -> DataFrame:
    """(request_id, text, error) by provider(system, user), a function that workers can load; an exception becomes the row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for system, user in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    texts.append(provider(system, user))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one failed request mustn't fail the others
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["request_id", "text", "error"])

    return requests.select("request_id", "system", "user").mapInArrow(run, "request_id string, text string, error string")


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outputs, facts, errors) of responses(session_id, text): title and tags; well-formed facts in order, with low_confidence; and the
    sessions whose response isn't an object with a title and a list of facts. Facts of unknown kind or without a field are dropped, one by one."""
    v = F.try_parse_json(F.coalesce(json_object_in(unfence("text", "json")), F.lit("")))
    none = F.array().cast("array<variant>")
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    rows = once(responses.select("session_id", "text"), v=v)
    rows = once(rows.drop("text"), title_kind=kind("title"), list_kind=kind("extracted"))
    error = F.when(F.col("v").isNull(), "no JSON object").when(~F.coalesce(F.col("title_kind") == "STRING", F.lit(False)), "no title").when(~F.coalesce(F.col("list_kind").startswith("ARRAY"), F.lit(False)), "no list of facts")
    rows = once(rows, error=error)
    good = rows.where("error IS NULL")
    tags = F.filter(F.transform(F.coalesce(F.try_variant_get("v", "$.tags", "array<variant>"), none), lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string"))), lambda t: t.isNotNull())
    each = good.select("session_id", F.posexplode(F.try_variant_get("v", "$.extracted", "array<variant>")).alias("fact_ord", "f"))
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get("f", f"$.{f}", "variant")) == "STRING", F.try_variant_get("f", f"$.{f}", "string"))
    names = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    confidence = F.when(F.try_variant_get("f", "$.confidence", "variant").isNull(), F.lit(1.0)).otherwise(F.try_variant_get("f", "$.confidence", "double")).cast("float")
    fields = {n: text(f) for f, n in (("type", "kind"), ("page_slug", "page_slug"), ("page_title", "page_title"), ("summary", "summary"), ("body_markdown", "body_markdown"))}
    facts = once(each, **fields, r=F.from_json(F.to_json(F.try_variant_get("f", "$.relations", "variant")), _RELATIONS), confidence=confidence)
    needed = ("page_slug", "page_title", "summary", "body_markdown", "confidence")
    facts = facts.where(F.col("kind").isin(*KIND_DIRS) & F.expr(" AND ".join(f"{c} IS NOT NULL" for c in needed)))
    r = F.col("r")
    relations = F.struct(names(r["uses"]).alias("uses"), names(r["used-by"]).alias("used_by"), names(r["related"]).alias("related"), names(r["supersedes"]).alias("supersedes"))
    facts = facts.select("session_id", "fact_ord", *fields, relations.alias("relations"), "confidence")
    outputs = good.select("session_id", F.try_variant_get("v", "$.title", "string").alias("title"), tags.alias("tags"))
    return outputs, facts.withColumn("low_confidence", F.col("confidence") < 0.5), rows.where("error IS NOT NULL").select("session_id", "error")


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """lint decisions of responses(ord, kind_a, slug_a, kind_b, slug_b, text): anything but a valid merge is keep."""
    v = F.try_parse_json(F.coalesce(json_object_in(unfence("text", "json")), F.lit("")))
    get = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    rows = responses.withColumn("v", v).select("ord", "kind_a", "slug_a", "kind_b", "slug_b", get("decision").alias("decision"), get("winning_slug").alias("winner"), get("merged_body").alias("merged_body"), get("reason").alias("reason"))
    merges = (F.col("decision") == "merge") & F.col("winner").isNotNull() & F.col("merged_body").isNotNull()
    return rows.withColumn("verdict", F.when(F.coalesce(merges, F.lit(False)), "merge").otherwise("keep"))


def parse_audits(responses: DataFrame) -> DataFrame:
    """audit verdicts of responses(kind_dir, slug, text): anything but the three known ones is keep."""
    v = F.try_parse_json(F.coalesce(json_object_in(unfence("text", "json")), F.lit("")))
    get = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    rows = responses.withColumn("v", v).select("kind_dir", "slug", get("verdict").alias("verdict"), get("reason").alias("reason"), get("log_line").alias("log_line"))
    return rows.withColumn("verdict", F.when(F.col("verdict").isin("move-to-log", "delete"), F.col("verdict")).otherwise("keep"))
