"""A store of pages and what derives from them, changed by whole transactions.

A version is one mark that names the folders of all tables: pages as a base and later changes, log, raw copies and run records as
the parts they were appended in, and the index. A transaction writes its rows to a folder of its own and then claims the next mark;
readers see all of it or nothing. Writers don't wait for each other. One that finds its mark taken works out its changes again on what
the winner left, so the outcome is that of one after the other, in the order of marks; only the folder of the vain attempt goes.

Pages are known by kind and slug, and the latest change of a page stands; a deleted page is a change too. So a transaction writes the
pages it touches, not all. When changes are many, they are folded into a new base, by the same claim.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import PageFormat
from lodestrand.operators import pages as page_operators
from lodestrand.operators.lineage import cut
from lodestrand.plans import jobs
from lodestrand.sources import sinks
from lodestrand.sources.pages import as_parsed, index_entries, page_path, render_page, topics
from lodestrand.sources.runs import RUN_SCHEMA
from lodestrand.sources.text_files import write_files

PAGES = "kind_dir string, slug string, front string, body string"
CHANGES = f"{PAGES}, gone boolean"
APPENDED = {"log": "ts timestamp, ord string, title string, touched array<string>", "raw": "name string, text string", "records": RUN_SCHEMA, "maintenance": "ord bigint, entry string"}
MOST_CHANGES = 16


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one version. mark is None for an empty store."""

    store: Vault
    mark: str | None
    folders: dict[str, list[str]]

    def _read(self, table: str, schema: str) -> DataFrame:
        spark, parts = self.store.spark, self.folders.get(table, [])
        return spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)

    def pages(self) -> DataFrame:
        """(kind_dir, slug, front, body): the base without the pages that changed, and each of these as it was last left."""
        base, key = self._read("base", PAGES), ["kind_dir", "slug"]
        parts = self.folders.get("changes", [])
        if not parts:
            return base
        read = self.store.spark.read.schema(CHANGES)
        changes = [read.parquet(f"{self.store.root}/{p}").withColumn("at", F.lit(n)) for n, p in enumerate(parts)]
        every = changes[0]
        for more in changes[1:]:
            every = every.unionByName(more)
        last = every.groupBy(*key).agg(F.max_by(F.struct("front", "body", "gone"), "at").alias("p"))
        return base.join(last.select(*key), key, "left_anti").unionByName(last.where("NOT p.gone").select(*key, "p.front", "p.body"))

    def topics(self, fmt: PageFormat = PageFormat()) -> DataFrame:
        return topics(as_parsed(self.pages()), fmt)

    def appended(self, table: str) -> DataFrame:
        return self._read(table, APPENDED[table])

    def index_rows(self) -> DataFrame | None:
        """The index as a row (text)."""
        return self._read("index", "text string") if self.folders.get("index") else None

    def index(self) -> str | None:
        row = rows.first() if (rows := self.index_rows()) is not None else None
        return row["text"] if row else None


@dataclass(frozen=True)
class Change:
    """What a transaction does: pages written, pages gone (kind_dir, slug), and rows for the appended tables. reindex: whether the index is
    written anew."""

    pages: DataFrame | None = None
    gone: DataFrame | None = None
    appended: dict[str, DataFrame] = field(default_factory=dict)
    reindex: bool = True


class Vault(sinks.VersionedTable):
    """The store at a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, fmt: PageFormat = PageFormat()):
        super().__init__(spark, root)
        self.fmt = fmt

    def snapshot(self) -> Snapshot:
        mark = self.current()
        return Snapshot(self, mark, json.loads(self._get(mark)) if mark else {})

    def _get(self, name: str) -> str:
        files, where = self._path(name)
        stream = files.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim_next(self, mark: str | None, folders: dict[str, list[str]], own: str) -> None:
        name = f"current-{1 + (int(mark.split('-')[1]) if mark else 0):012d}"
        files, made = self._path(f".mark-{own}")
        stream = files.create(made, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if not self._claim(files, made, self._path(name)[1]):
            files.delete(made, False)
            raise Conflict(name)

    def _drop(self, folder: str) -> None:
        files, where = self._path(folder)
        files.delete(where, True)

    def commit(self, seen: Snapshot, change: Change) -> Snapshot:
        """The version after seen with the change in it; Conflict, with nothing left behind, if seen is no longer the last."""
        own = f"v{uuid.uuid4().hex}"
        folders = {k: list(v) for k, v in seen.folders.items()}
        try:
            written = [x for x in ((change.pages, False), (change.gone, True)) if x[0] is not None]
            if written:
                rows = [df.select("kind_dir", "slug", *([F.lit(None).cast("string").alias(c) for c in ("front", "body")] if gone else ["front", "body"]), F.lit(gone).alias("gone")) for df, gone in written]
                self._put(rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0], own, "changes", folders)
            for table, df in change.appended.items():
                self._put(df.select(*[c.split()[0] for c in APPENDED[table].split(", ")]), own, table, folders)
            if change.reindex:
                after = Snapshot(self, None, folders)
                folders["index"] = []
                self._put(sinks.reindex(index_entries(as_parsed(after.pages())), seen.index_rows(), self.fmt), own, "index", folders)
            if len(folders.get("changes", [])) > MOST_CHANGES:
                after = Snapshot(self, None, {k: folders.get(k, []) for k in ("base", "changes")}).pages()
                folders |= {"base": [], "changes": []}
                self._put(after, own, "base", folders)
            self._claim_next(seen.mark, folders, own)
        except BaseException:
            self._drop(own)
            raise
        return Snapshot(self, None, folders)

    def _put(self, df: DataFrame, own: str, table: str, folders: dict[str, list[str]]) -> None:
        df.write.parquet(f"{self.root}/{own}/{table}")
        folders.setdefault(table, []).append(f"{own}/{table}")

    def update(self, change: Callable[[Snapshot], Change], tries: int = 20) -> Snapshot:
        """Commits change(snapshot), worked out again on a newer snapshot as often as another writer is first."""
        for _ in range(tries):
            seen = self.snapshot()
            try:
                return self.commit(seen, change(seen))
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def load(self, pages: DataFrame) -> Snapshot:
        """Adds or replaces pages(kind_dir, slug, front, body)."""
        return self.update(lambda _: Change(pages=pages))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes marks but the last `keep`, and the folders that no mark left names. Not while others read or write older versions. Gives the number
        of folders deleted."""
        files, root = self._path("")
        names = sorted(x.getPath().getName() for x in files.listStatus(root))
        marks = [n for n in names if n.startswith("current-")]
        kept = marks[-keep:]
        held = {p.split("/")[0] for m in kept for parts in json.loads(self._get(m)).values() for p in parts}
        gone = [n for n in names if n.startswith("v") and n not in held]
        for name in [*[m for m in marks if m not in kept], *gone]:
            self._drop(name)
        return len(gone)

    def export(self, folder: str, since: Snapshot | None = None) -> None:
        """Pages, index, log and raw copies as files below the folder; with `since`, the pages that changed after it, deletions included."""
        seen = self.snapshot()
        text = lambda rows, path, c="text": rows.select(path.alias("path"), F.col(c).alias("text"))
        now = seen.pages().withColumn("text", render_page("front", "body"))
        out = text(now, page_path("kind_dir", "slug"))
        if since is not None:
            key = ["kind_dir", "slug"]
            old = since.pages().withColumns({"f": F.col("front"), "b": F.col("body"), "was": F.lit(True)}).drop("front", "body")
            joined = now.withColumn("is", F.lit(True)).join(old, key, "full_outer")
            same = F.col("is") & F.col("was") & F.col("f").eqNullSafe(F.col("front")) & F.col("b").eqNullSafe(F.col("body"))
            out = text(joined.where(~F.coalesce(same, F.lit(False))), page_path("kind_dir", "slug"))
        log = sinks.render_log(seen.appended("log")).agg(F.array_sort(F.collect_list(F.struct("day", "section"))).alias("days"))
        whole = F.concat(F.lit(sinks.LOG_HEADER), F.array_join(F.transform("days", lambda d: F.concat(F.lit("\n"), d.section)), ""), F.coalesce(F.col("entries"), F.lit("")))
        entries = seen.appended("maintenance").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda e: e.entry), "").alias("entries"))
        out = out.unionByName(log.join(entries).select(F.lit("wiki/log.md").alias("path"), whole.alias("text")))
        out = out.unionByName(text(seen.appended("raw"), F.concat(F.lit("raw/sessions/"), F.col("name"))))
        index = seen.index_rows()
        if index is not None:
            out = out.unionByName(text(index.where("text IS NOT NULL"), F.lit("wiki/index.md")))
        write_files(out, folder)


def archive(vault: Vault, prepared: jobs.Prepared, responses: DataFrame, now: Column, today: str, transcripts: DataFrame | None = None, tries: int = 20) -> Snapshot:
    """jobs.ingest() of sessions as one transaction: pages, log, index, raw copies and run records appear together or not at all. Responses are those
    given, also when another writer was first; facts are resolved again, against the pages that the winner left."""

    def change(seen: Snapshot) -> Change:
        out = jobs.ingest(prepared, responses, cut(seen.topics(vault.fmt)), seen.pages(), now, today, vault.fmt, transcripts)
        return Change(pages=out.changed, appended={"log": out.log, "raw": out.raw, "records": out.records})

    return vault.update(change, tries)


def apply_lint(vault: Vault, decisions: DataFrame, now: Column) -> Snapshot:
    """Merges as one transaction: winners rewritten, losers gone, an entry for each. Decisions on pages that are gone meanwhile change nothing."""

    def change(seen: Snapshot) -> Change:
        old, key = seen.pages(), ["kind_dir", "slug"]
        known = [F.struct(F.col(f"kind_{x}").alias("kind_dir"), F.col(f"slug_{x}").alias("slug")) for x in "ab"]
        there = decisions
        for side in known:
            there = there.withColumn("side", side).join(old.select(F.struct(*key).alias("side")), "side", "left_semi").drop("side")
        left, log, _ = jobs.apply_lint(old, there, now, vault.fmt)
        changed = left.join(old.select(*key, F.col("body").alias("was")), key).where("body <> was").drop("was")
        number = F.row_number().over(Window.orderBy("ord"))  # as many as there are merges of one run
        return Change(pages=changed, gone=old.join(left.select(*key), key, "left_anti"), appended={"maintenance": log.select(number.cast("bigint").alias("ord"), "entry")})

    return vault.update(change)


def apply_audit(vault: Vault, responses: DataFrame, now: Column) -> Snapshot:
    """Audit verdicts as one transaction: pages deleted, or moved to the log as an entry. The index is written anew if any goes."""

    def change(seen: Snapshot) -> Change:
        left, log = jobs.audit(seen.pages(), responses, now)
        gone = log.select("kind_dir", "slug")
        number = F.xxhash64("kind_dir", "slug").alias("ord")
        return Change(gone=gone, appended={"maintenance": log.select(number, "entry")}, reindex=not gone.isEmpty())

    return vault.update(change)


def apply_consolidate(vault: Vault, responses: DataFrame, now: Column) -> Snapshot:
    """responses(kind_dir, slug, text) as one transaction: pages of two blocks and more with one block in place of all; `updated` stays."""

    def change(seen: Snapshot) -> Change:
        said = responses.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumnRenamed("text", "consolidated")  # an empty response is an error
        rows = jobs.with_titles(seen.pages(), F.lit(jobs.UNTITLED)).join(said, ["kind_dir", "slug"])
        return Change(pages=_changed(page_operators.consolidate(rows.withColumn("was", F.col("body")), now, vault.fmt)), reindex=False)

    return vault.update(change)


def apply_rewrite(vault: Vault, responses: DataFrame, now: Column) -> Snapshot:
    """responses(kind_dir, slug, text) as one transaction: first blocks rewritten, unless the response says to skip the page."""

    def change(seen: Snapshot) -> Change:
        rows = seen.pages().join(responses.withColumnRenamed("text", "response"), ["kind_dir", "slug"])
        return Change(pages=_changed(page_operators.rewrite(rows.withColumn("was", F.col("body")), now, vault.fmt)), reindex=False)

    return vault.update(change)


def _changed(rows: DataFrame) -> DataFrame:
    return rows.where("body <> was").select("kind_dir", "slug", "front", "body")
