"""Sinks: versioned tables, append-only ledgers and single-file exports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import PageFormat, insert_under_heading
from lodestrand.functions.times import day, file_stamp, minute, relative_time

LOG_HEADER = "# Log\n"
EMPTY = {"entities": "_Empty — no entities yet._\n", "concepts": "_Empty — no concepts yet._\n"}
HEADINGS = {"entities": "## Projects (entities)", "concepts": "## Concepts"}


def write_atomic(path: str | Path, text: str) -> None:
    """Temporary file in the same folder, then a rename; parents are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


class VersionedTable:
    """A table whose versions are folders. A mark, numbered without gaps, holds the name of its version's folder. A mark is made whole and only
    if its number is free, so of writers that race for a number one succeeds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def current(self) -> str | None:
        files, root = self._path("")
        if not files.exists(root):
            return None
        marks = sorted(x.getPath().getName() for x in files.listStatus(root) if x.getPath().getName().startswith("current-"))
        return marks[-1] if marks else None

    def read(self) -> DataFrame | None:
        mark = self.current()
        if mark is None:
            return None
        files, where = self._path(mark)
        stream = files.open(where)
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.root}/{name}")

    def commit(self, df: DataFrame, expected: str | None) -> str:
        """Writes df as the next version; fails if another writer committed since `expected` was read."""
        name = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        mark = f"current-{1 + (int(expected.split('-')[1]) if expected else 0):012d}"
        files, made = self._path(f".mark-{name}")
        stream = files.create(made, False)
        stream.writeUTF(name)
        stream.close()
        if not self._claim(files, made, self._path(mark)[1]):
            files.delete(made, False)
            raise RuntimeError("another writer committed first")
        return mark

    def _claim(self, files, made, mark) -> bool:
        """Gives a finished mark its name, unless the name is taken. A shared store's rename refuses that; a local one replaces, so there
        a hard link is made, which doesn't."""
        if files.getScheme() != "file":
            return not files.exists(mark) and files.rename(made, mark)
        source, target = (x.toUri().getPath() for x in (made, mark))
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        os.unlink(source)
        return True


def store_sessions(events: DataFrame, name: str, buckets: int) -> DataFrame:
    """events as a table of `buckets` files' worth of sessions, each file in the stored order: by session, then timestamp text, nulls last, then
    position. What windows, groups or joins by session reads it without a shuffle."""
    rows = events.withColumn("undated", F.col("ts_raw").isNull()).repartition(buckets, "session_id")
    rows.write.mode("overwrite").bucketBy(buckets, "session_id").sortBy("session_id", "undated", "ts_raw", "source_rank", "line_no").saveAsTable(name)
    return events.sparkSession.table(name).drop("undated")


def new_rows(rows: DataFrame, existing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows split into those with a key in existing and those without."""
    keys = existing.select(*key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def render_index(entries: DataFrame) -> DataFrame:
    """One row: the index text of entries(kind_dir, slug, title), entities before concepts, each by title."""
    line = F.concat(F.lit("- [["), "kind_dir", F.lit("/"), "slug", F.lit("]] · "), "title", F.lit("\n"))
    listed = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind_dir") == k, F.struct("title", "slug", line.alias("line"))))), lambda x: x.line), "")
    one = entries.agg(listed("entities").alias("entities"), listed("concepts").alias("concepts"))
    part = lambda k: F.concat(F.lit(f"\n{HEADINGS[k]}\n\n"), F.when(F.col(k) == "", EMPTY[k]).otherwise(F.col(k)))
    return one.select(F.concat(part("entities"), part("concepts"), F.lit("\n")).alias("inside"))


def reindex(entries: DataFrame, existing: str | DataFrame | None, pages: PageFormat = PageFormat()) -> DataFrame:
    """One row: the index file, or a new one, with its region written anew. existing may be a row (text), which then needn't pass the driver."""
    inside = render_index(entries)
    if isinstance(existing, DataFrame):
        both = inside.join(existing.select(F.col("text").alias("old")), F.lit(True), "left")
        return both.select(pages.replace_region(F.coalesce("old", F.lit(pages.new_index)), "inside").alias("text"))
    return inside.select(pages.replace_region(F.lit(pages.new_index if existing is None else existing), "inside").alias("text"))


def log_entry(ts: str, title: str, touched: str):
    links = F.array_join(F.transform(touched, lambda p: F.concat(F.lit("[["), p, F.lit("]]"))), " ")
    return F.concat(F.lit("- "), minute(ts), F.lit(" "), title, F.lit(" → "), links)


def append_log(existing: str | None, row: DataFrame) -> DataFrame:
    """The log with the entry of row(ts, title, touched) in its day's section."""
    text = LOG_HEADER if existing is None else existing
    return row.select(insert_under_heading(F.lit(text), F.concat(F.lit("## "), day("ts")), log_entry("ts", "title", "touched")).alias("text"))


def render_log(rows: DataFrame) -> DataFrame:
    """(day, section): the log's sections from rows(ts, ord, title, touched)."""
    entries = rows.groupBy(day("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "ord", log_entry("ts", "title", "touched").alias("entry")))).alias("e"))
    return entries.select("day", F.concat(F.lit("## "), "day", F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x.entry), "\n"), F.lit("\n")).alias("section"))


def raw_copies(transcripts: DataFrame, note: str = "Raw session transcript (JSONL).") -> DataFrame:
    """(name, text) of transcripts(session_id, started_at, raw, title, tags): fenced copies for reading, with the session's title and tags, which
    live here only; an unreadable transcript is empty."""
    name = F.concat(file_stamp("started_at"), F.lit("_"), F.substring("session_id", 1, 12), F.lit(".md"))
    listed = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("\n  - "), t)), "")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:"), listed)).otherwise("tags: []")
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntype: source\ncreated: "), day("started_at"), F.lit("\n"), tags, F.lit("\n---\n\n# "), "title", F.lit(f"\n\n{note}\n\n"))
    return transcripts.select(name.alias("name"), F.concat(head, F.lit("```jsonl\n"), F.coalesce("raw", F.lit("")), F.lit("\n```\n")).alias("text"))


def next_snapshot(names: DataFrame) -> DataFrame:
    """One row: the number after the greatest numeric stem of names(name)."""
    stem = F.expr("try_cast(regexp_extract(name, '^(.*)\\\\.jsonl$', 1) AS int)")
    return names.agg((F.coalesce(F.max(stem), F.lit(0)) + 1).alias("n")).select(F.format_string("%04d.jsonl", "n").alias("name"))


def maintenance_entry(op: str, now, text):
    return F.concat(F.lit("\n## ["), day(now), F.lit(f"] {op} | "), text, F.lit("\n"))


def status_rows(runs: DataFrame, now, n: int = 10) -> DataFrame:
    """Newest runs first: icon, when, session (8 characters), pages, tokens, error (120 characters)."""
    tokens = F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), F.format_string("tokens: %d in / %d out", "input_tokens", "output_tokens"))
    return runs.orderBy(F.desc("line_no")).limit(n).select(
        "line_no", F.when(F.col("error").isNull(), "✓").otherwise("✗").alias("icon"), relative_time("finished_at", now).alias("when"), F.substring("session_id", 1, 8).alias("session"),
        F.when(F.col("error").isNull(), F.col("touched_pages")).alias("pages"), tokens.alias("tokens"), F.substring("error", 1, 120).alias("error"),
    )


def append_rows(df: DataFrame, path: str) -> None:
    """An append-only ledger as JSON lines."""
    df.write.mode("append").json(path)
