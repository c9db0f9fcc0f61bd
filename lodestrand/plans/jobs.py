"""Whole jobs over tables: ingest, replay, dry run, lint, audit, consolidate, rewrite, reindex, status.

Clock, session order and model responses are inputs, so a job gives the same result each time it runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import PageFormat
from lodestrand.operators import near_pages, pages, requests, sessions
from lodestrand.operators.lineage import cut
from lodestrand.sources import pages as page_source
from lodestrand.sources import runs, sinks
from lodestrand.sources.pages import front_value, index_entries, log_link, page_path

#: Fixed value: the title of a page without one, where its blocks become one.
UNTITLED = "Untitled"


@dataclass(frozen=True)
class Prepared:
    """What a run needs before any response: one row per session each."""

    metadata: DataFrame
    messages: DataFrame
    calls: DataFrame
    requests: DataFrame


def prepare(events: DataFrame, topics: DataFrame, template: runs.Template, skip_paths: list[str] = (), vault_language: str | None = None) -> Prepared:
    """Snapshots merged, sessions in skipped folders left out, and a request per session, within the template's byte caps."""
    merged = sessions.merge_snapshots(events)
    metadata = sessions.skip_canonical(sessions.session_metadata(merged), list(skip_paths)).where("skip_path IS NULL").drop("skip_path")
    merged = merged.join(metadata.select("session_id"), "session_id", "left_semi")
    messages, calls = sessions.reconstruct(merged)
    known = requests.session_values(metadata, messages, calls, template.caps)
    made = requests.build_requests(
        known, topics, template.system, template.user, template.model or "", template.max_tokens,
        max_facts=template.max_facts, max_body_chars=template.max_body_chars, vault_language=vault_language,
    )
    return Prepared(metadata, messages, calls, made)


def dry_run(events: DataFrame, template: runs.Template, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outputs, facts and errors of the responses, without topics and without writing anything."""
    none = events.sparkSession.createDataFrame([], "kind_dir string, slug string, title string, summary string")
    made = prepare(events, none, template)
    return requests.parse_responses(requests.recorded_responses(made.requests, responses).select("session_id", "text"))


def stages(prepared: Prepared, responses: DataFrame) -> dict[str, DataFrame]:
    """What a run passes from stage to stage, by the name of the stage, for looking at."""
    answered = requests.recorded_responses(prepared.requests, responses)
    outputs, facts, errors = requests.parse_responses(answered.select("session_id", "text"))
    return {
        "metadata": prepared.metadata, "messages": prepared.messages, "tool_calls": prepared.calls, "requests": prepared.requests.select("session_id", "system", "user"),
        "raw_output": answered.select("session_id", "text"), "outputs": outputs, "facts": facts, "errors": errors,
    }


def dump_stages(prepared: Prepared, responses: DataFrame, folder: str) -> dict[str, str]:
    """Writes stages() as JSON lines, a folder each, for looking at. A stage that can't be written keeps no other from it; gives the errors by stage."""
    failed = {}
    for name, frame in stages(prepared, responses).items():
        try:
            frame.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
        except Exception as e:  # noqa: BLE001  looking at a run mustn't break it
            failed[name] = str(e)
    return failed


@dataclass(frozen=True)
class Ingested:
    """pages: all pages after the run. log: (ts, ord, title, touched) of every session that wrote. raw: (name, text), a readable copy of
    every transcript. index: one row, the index file's text. records: a run record per session, with its error if it has one. changed: the
    pages that the run wrote."""

    pages: DataFrame
    log: DataFrame
    raw: DataFrame
    index: DataFrame
    records: DataFrame
    changed: DataFrame


def ingest(
    prepared: Prepared, responses: DataFrame, topics: DataFrame, old_pages: DataFrame, now: Column, today: str, fmt: PageFormat = PageFormat(),
    transcripts: DataFrame | None = None, existing_index: str | None = None,
) -> Ingested:
    """Facts of all responses resolved and folded into pages, as if session after session. A session whose response fails has a record
    with the error and changes nothing; the others go on. transcripts(session_id, raw) are copied for reading."""
    answered = cut(requests.recorded_responses(prepared.requests, responses).select("session_id", "text"))
    outputs, facts, errors = requests.parse_responses(answered)
    stem = F.concat(sinks.file_stamp(now), F.lit("_"), F.substring("session_id", 1, 12))
    # Written once: pages, log and records all come from it.
    resolved = cut(pages.resolve(cut(facts), topics)).withColumn("source", F.concat(F.lit("[[../raw/sessions/"), stem, F.lit("]]")))
    folded = pages.fold_facts(resolved, old_pages, today, fmt)
    kept = old_pages.select("kind_dir", "slug", "front", "body").join(folded.select("kind_dir", "slug"), ["kind_dir", "slug"], "left_anti")
    after = folded.unionByName(kept)
    path = page_path("kind_dir", "target_slug")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("fact_ord", "path"))), lambda x: x.path)
    touched = resolved.withColumn("path", path).groupBy("session_id").agg(listed.alias("touched"))
    none = F.array().cast("array<string>")
    log = outputs.join(touched, "session_id", "left").select(now.alias("ts"), F.col("session_id").alias("ord"), "title", F.transform(F.coalesce("touched", none), log_link).alias("touched"))
    named = outputs.select("session_id", "title", "tags")
    texts = named.join(transcripts, "session_id", "left") if transcripts is not None else named.withColumn("raw", F.lit(None).cast("string"))
    raw = sinks.raw_copies(texts.withColumn("started_at", now))
    index = sinks.reindex(index_entries(after), existing_index, fmt)
    records = prepared.metadata.join(touched, "session_id", "left").join(errors, "session_id", "left").select(
        "session_id", now.alias("started_at"), now.alias("finished_at"), F.coalesce("touched", none).alias("touched_pages"), "error", "input_tokens", "output_tokens"
    )
    return Ingested(after, log, raw, index, records, folded)


def replay(prepared: Prepared, responses: DataFrame, listing: DataFrame, topics: DataFrame, old_pages: DataFrame, now: Column, today: str) -> Ingested:
    """ingest for the listed sessions only; facts apply in the order of session ids."""
    only = lambda df: df.join(listing.select("session_id").distinct(), "session_id", "left_semi")
    return ingest(Prepared(only(prepared.metadata), only(prepared.messages), only(prepared.calls), only(prepared.requests)), responses, topics, old_pages, now, today)


def progress(listing: DataFrame) -> DataFrame:
    """listing with the number of each session in the run, from 1, by id, and how many there are. Sessions are sorted by ranges and numbered within
    them, and a range is shifted by what the ranges before it hold; only the ranges' counts meet in one task."""
    ranged = cut(listing.repartitionByRange("session_id", "path").sortWithinPartitions("session_id", "path")).withColumn("range", F.spark_partition_id())
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("session_id", "path"))
    numbered = ranged.withColumn("nth", nth).join(shifts, "range").withColumn("n", F.col("nth") + F.col("shift"))
    return numbered.join(listing.agg(F.count("*").alias("of"))).drop("range", "nth", "shift")


def lint(topics: DataFrame, responses: DataFrame | None = None, blocked: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, decisions): candidates, and what responses(kind_a, slug_a, kind_b, slug_b, text) say of them; a pair without a valid
    response is kept."""
    pairs = near_pages.near_pairs_blocked(topics) if blocked else near_pages.near_pairs(topics)
    if responses is None:
        return pairs, None
    key = ["kind_a", "slug_a", "kind_b", "slug_b"]
    asked = pairs.join(responses, key, "left").select(F.struct((-F.col("score")).alias("by_score"), "slug_a", "slug_b", "kind_a", "kind_b").alias("ord"), *key, "text")
    return pairs, requests.parse_verdicts(asked)


def apply_lint(old_pages: DataFrame, decisions: DataFrame, now: Column, fmt: PageFormat = PageFormat()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, log, report) after the merges, in order; a page that a merge removed takes part in none after it."""
    merges = cut(near_pages.killset_fold(decisions).join(decisions.select("ord", "merged_body", "reason"), "ord"))
    left, log = pages.apply_merges(old_pages, merges, now, fmt)
    return left, log, near_pages.lint_report(decisions, merges)


def with_titles(old_pages: DataFrame, otherwise: Column | None = None) -> DataFrame:
    """pages with their title; where they have none, the slug, or what is said."""
    return old_pages.withColumn("title", F.coalesce(front_value("front", "title"), F.col("slug") if otherwise is None else otherwise))


def maintenance_requests(op: str, old_pages: DataFrame, template: runs.Template, pairs: DataFrame | None = None, fmt: PageFormat = PageFormat()) -> DataFrame:
    """Requests of lint, audit, consolidate or rewrite over all pages(kind_dir, slug, front, body). Lint asks about candidate pairs, by default those of
    lint(); its pages are whole files."""
    if op == "lint":
        topics = page_source.topics(page_source.as_parsed(old_pages), fmt)
        found = lint(topics)[0] if pairs is None else pairs
        named = with_titles(old_pages).select("kind_dir", "slug", "title")
        for x in "ab":
            found = found.drop(f"title_{x}").join(named.withColumnsRenamed({"kind_dir": f"kind_{x}", "slug": f"slug_{x}", "title": f"title_{x}"}), [f"kind_{x}", f"slug_{x}"])
        return requests.lint_requests(found, old_pages.withColumn("text", page_source.render_page("front", "body")), template)
    if op == "audit":
        return requests.audit_requests(with_titles(old_pages), template)
    if op == "consolidate":
        return requests.consolidate_requests(with_titles(old_pages, F.lit(UNTITLED)), template, fmt)
    if op == "rewrite":
        return requests.rewrite_requests(with_titles(old_pages), template, fmt)
    raise ValueError(f"no maintenance: {op}")


def audit(old_pages: DataFrame, responses: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    return pages.audit(old_pages, requests.parse_audits(responses), now)


def audit_report(verdicts: DataFrame) -> DataFrame:
    """Verdicts page by page, by slug."""
    return verdicts.select("slug", "kind_dir", "verdict", "reason").orderBy("slug", "kind_dir")


def verdict_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("verdict").count().orderBy("verdict")


def reindex(parsed_pages: DataFrame, existing: str | None, fmt: PageFormat = PageFormat()) -> str:
    return sinks.reindex(index_entries(parsed_pages), existing, fmt).first()["text"]


def status(run_lines: DataFrame, now: Column, n: int = 10) -> DataFrame:
    return sinks.status_rows(runs.last_runs(run_lines, n), now, n)
