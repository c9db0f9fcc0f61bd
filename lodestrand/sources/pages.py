"""Topic pages: Markdown with a YAML front-matter, scanned into tables and rendered back."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import PageFormat
from lodestrand.sources.text_files import read_files

#: Fixed values.
KIND_DIRS = {"entity": "entities", "concept": "concepts", "decision": "concepts", "gotcha": "concepts"}
OWNED_KEYS = ("title", "type", "tags", "created", "updated", "sources", "relations")


def kind_dir(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, folder in KIND_DIRS.items():
        out = F.when(kind == name, folder).otherwise(out)
    return out


def page_path(folder: Column | str, slug: Column | str) -> Column:
    return F.format_string("wiki/%s/%s.md", F.col(folder) if isinstance(folder, str) else folder, F.col(slug) if isinstance(slug, str) else slug)


def log_link(path: Column | str) -> Column:
    return F.regexp_replace(path, r"^wiki/|\.md$", "")


#: A line of three dashes at the very beginning, up to the first line that is nothing else, and the blank line behind it.
_FENCED = r"(?s)\A---\r?\n((?:.*?\n)?)---\r*(?:\n|\z)(?:\r?\n)?(.*)\z"


def split_front_matter(raw: Column | str) -> tuple[Column, Column]:
    """(front-matter text or null, body). It must begin the file; one that isn't closed leaves everything as body."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    has = raw.rlike(_FENCED)
    return F.when(has, F.regexp_extract(raw, _FENCED, 1)), F.when(has, F.regexp_extract(raw, _FENCED, 2)).otherwise(raw)


#: The scalars that YAML 1.2's core schema doesn't read as text, but for whole numbers with zeros in front, which are text here.
CORE_SCALARS = {
    "null": (r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    "bool": (r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    "int": (r"[-+]?(0|[1-9][0-9]*)|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    "float": (r"[-+]?(\.[0-9]+|[0-9]+\.[0-9]*)([eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", list("-+.0123456789")),
}


@lru_cache(maxsize=1)
def _yaml() -> tuple[type, type]:
    """A loader and a dumper of YAML 1.2's core schema, in which dates are text, and keys don't repeat."""
    import re

    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def whole(self, node):
            text = self.construct_scalar(node)
            return int(text[2:], 8 if text[1] == "o" else 16) if text[1:2] in ("o", "x") else int(text)

        def mapping(self, node):
            found = {}
            for key, value in node.value:
                name = self.construct_object(key, deep=True)
                if not isinstance(name, (str, int, float, type(None))) or name in found:
                    raise yaml.constructor.ConstructorError(None, None, "key repeats or is no scalar", key.start_mark)
                found[name] = self.construct_object(value, deep=True)
            return found

    class Dumper(yaml.SafeDumper):
        yaml_implicit_resolvers: dict = {}

    for name, (pattern, first) in CORE_SCALARS.items():
        for kind in (Loader, Dumper):
            kind.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(f"^(?:{pattern})$"), first)
    Loader.add_constructor("tag:yaml.org,2002:int", Loader.whole)
    Loader.add_constructor("tag:yaml.org,2002:map", Loader.mapping)
    return Loader, Dumper


@lru_cache(maxsize=1024)
def _entries(text: str | None) -> str | None:
    import yaml

    if text is None:
        return None
    try:
        found = yaml.load(text, _yaml()[0])
        return json.dumps(list(map(list, (found or {}).items())), ensure_ascii=False, allow_nan=False) if isinstance(found, dict | None) else None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


@lru_cache(maxsize=1024)
def _front_text(entries: str | None) -> str | None:
    import yaml

    found = dict(json.loads(entries)) if entries is not None else {}
    return yaml.dump(found, Dumper=_yaml()[1], allow_unicode=True, sort_keys=False, default_flow_style=False, width=1 << 30) if found else None


# Row by row, as YAML takes far longer than rows do to reach it: workers then hold a hundred rows, not ten thousand, and load no pandas.
@F.udf(T.StringType(), useArrow=False)
def yaml_to_entries(text: str | None) -> str | None:
    """YAML mappings as JSON arrays of [key, value], which keep order and types, nested ones included. Null for YAML that is no mapping or doesn't
    parse, repeats a key, or holds what JSON can't: infinite numbers and tagged values."""
    return _entries(text)


@F.udf(T.StringType(), useArrow=False)
def entries_to_yaml(entries: str | None) -> str | None:
    """The other way round; used when pages are exported. Null for none and for no entries."""
    return _front_text(entries)


def render_page(front: Column | str, body: Column | str) -> Column:
    """A page's text: its front-matter between fences and a blank line, then the body. Splitting it gives both back."""
    front, body = (F.col(c) if isinstance(c, str) else c for c in (front, body))
    fenced = F.concat(F.lit("---\n"), entries_to_yaml(front), F.lit("---\n"))
    return F.coalesce(F.concat(fenced, F.when(body != "", F.concat(F.lit("\n"), body)).otherwise("")), body)


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(kind_dir, slug, raw) of root/wiki/{concepts,entities}/*.md."""
    files = read_files(spark, [f"{root}/wiki/concepts", f"{root}/wiki/entities"], ".md")
    return files.select(F.regexp_extract("folder", r"/wiki/(\w+)$", 1).alias("kind_dir"), F.regexp_extract("name", r"^(.+)\.md$", 1).alias("slug"), F.col("text").alias("raw"))


def parse_pages(raw_pages: DataFrame) -> DataFrame:
    """raw_pages with front (JSON entries), body, and bad_front for a front-matter that doesn't parse."""
    front, body = split_front_matter("raw")
    rows = raw_pages.withColumns({"front_text": front, "body": body}).withColumn("front", yaml_to_entries("front_text"))
    return rows.withColumn("bad_front", F.col("front_text").isNotNull() & F.col("front").isNull()).drop("front_text")


def _listed(front: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(front), "$", "array<variant>")


def _key(entry: Column) -> Column:
    return F.try_variant_get(entry, "$[0]", "string")


def front_value(front: Column | str, key: str) -> Column:
    """A text of the front-matter; null for values of other types."""
    value = F.try_variant_get(F.get(F.filter(_listed(F.col(front) if isinstance(front, str) else front), lambda e: _key(e) == key), F.lit(0)), "$[1]", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def set_front(front: Column | str, key: str, value: Column) -> Column:
    """The front-matter with a text in place of the key's value, or at the end; other entries stay as they are, nested order included. A page
    without front-matter stays without."""
    text = F.col(front) if isinstance(front, str) else front
    entries = _listed(text)
    # A variant orders the keys of its objects, so values are taken as they are spelled; texts come without their quotes there.
    raw = lambda i: F.coalesce(F.call_function("get_json_object", text, F.concat(F.lit("$["), i.cast("string"), F.lit("][1]"))), F.lit("null"))
    is_text = lambda e: F.coalesce(F.schema_of_variant(F.try_variant_get(e, "$[1]", "variant")) == "STRING", F.lit(False))
    kept = lambda e, i: F.concat(F.lit("["), F.to_json(F.try_variant_get(e, "$[0]", "variant")), F.lit(", "), F.when(is_text(e), F.to_json(F.try_variant_get(e, "$[1]", "variant"))).otherwise(raw(i)), F.lit("]"))
    new = F.to_json(F.array(F.lit(key), value))
    old = F.transform(entries, lambda e, i: F.when(_key(e) == key, new).otherwise(kept(e, i)))
    there = F.exists(entries, lambda e: _key(e) == key)
    return F.concat(F.lit("["), F.array_join(F.when(there, old).otherwise(F.concat(old, F.array(new))), ", "), F.lit("]"))


def as_parsed(pages: DataFrame) -> DataFrame:
    """Stored pages(kind_dir, slug, front, body) as parse_pages() has them."""
    return pages.select("kind_dir", "slug", "front", "body", F.concat(F.coalesce("front", F.lit("")), "body").alias("raw"), F.lit(False).alias("bad_front"))


def topics(parsed: DataFrame, pages: PageFormat = PageFormat()) -> DataFrame:
    """(kind_dir, slug, title, summary) by slug; blank pages and those with a bad front-matter are left out."""
    rows = parsed.where((F.trim(F.regexp_replace("raw", r"\s+", " ")) != "") & ~F.col("bad_front"))
    return rows.select("kind_dir", "slug", F.coalesce(front_value("front", "title"), "slug").alias("title"), pages.summary("body").alias("summary")).orderBy("slug", "kind_dir")


def index_entries(parsed: DataFrame) -> DataFrame:
    """(kind_dir, slug, title) by title; unlike topics, blank pages count, with their slug as title."""
    return parsed.select("kind_dir", "slug", F.coalesce(front_value("front", "title"), "slug").alias("title")).orderBy("title", "slug")


def find_page(pages: DataFrame, slug: str) -> DataFrame:
    """The page of that slug, a concept before an entity."""
    return pages.where(F.col("slug") == slug).orderBy("kind_dir").limit(1)
