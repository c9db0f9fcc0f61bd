"""Queries of the catalog that write files, streams or stores from the driver's tables and read them back, and those of requests."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.catalog import _COPIES, _PAGES, _VERDICT, NOW, _copies_decided, _now, _t, _verdict, docs_as_pages, query
from lodestrand.functions import paths
from lodestrand.operators import responses, sessions
from lodestrand.operators.lineage import shared_folder
from lodestrand.plans import jobs, vault
from lodestrand.sources import pages as page_source
from lodestrand.sources import runs, sinks, text_files, transcripts
from lodestrand.streaming import arrivals, lifecycle

_NL = "chr(10)"


def _md5(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _slug(c: str = "doc_id") -> Column:
    return F.concat(F.lit("doc-"), F.col(c).cast("string"))


def _front(*entries: tuple[str, Column]) -> Column:
    """Front-matter as stored; texts only."""
    return F.to_json(F.array(*[F.array(F.lit(k), v) for k, v in entries]))


# ---- pages as files -------------------------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, CAST(n_chars AS BIGINT) AS priority, lang AS owner, md5('---' || {_NL} || 'title: ' || source || {_NL} || 'priority: ' || n_chars || {_NL} || 'draft: ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || {_NL}
  || 'note: null' || {_NL} || 'day: 2024-01-05' || {_NL} || 'share: 0.5' || {_NL} || 'owner:' || {_NL} || '  zeta: ' || doc_id || {_NL} || '  alpha:' || {_NL} || '  - x' || {_NL} || '  - ' || lang || {_NL}
  || 'updated: 2024-02-01' || {_NL} || '---' || {_NL} || CASE WHEN text = '' THEN '' ELSE {_NL} || text END) AS page FROM documents""")
def typed_front_matter(spark, sf_dir):
    """Pages whose front-matter has numbers, flags, nulls, dates and nested values of the user's, parsed, edited and rendered."""
    d = _t(spark, sf_dir, "documents")
    s = lambda c: F.col(c).cast("string")
    raw = F.concat(
        F.lit("---\ntitle: "), "source", F.lit("\npriority: "), s("n_chars"), F.lit("\ndraft: "), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit("\nnote: null\nday: 2024-01-05\nshare: 0.5\nowner:\n  zeta: "), s("doc_id"),
        F.lit("\n  alpha:\n  - x\n  - "), "lang", F.lit("\n---\n\n"), "text",
    )
    parsed = page_source.parse_pages(d.select("doc_id", raw.alias("raw"))).withColumn("front", page_source.set_front("front", "updated", F.lit("2024-02-01")))
    front = F.try_parse_json("front")
    page = page_source.render_page("front", "body")
    return parsed.select("doc_id", F.try_variant_get(front, "$[1][1]", "bigint").alias("priority"), F.try_variant_get(front, "$[6][1].alpha[1]", "string").alias("owner"), _md5(page).alias("page"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'entities' ELSE 'concepts' END AS kind_dir, 'doc-' || doc_id AS slug, source AS title, md5(text) AS body FROM documents WHERE doc_id % 5 <> 0")
def page_files(spark, sf_dir):
    """Documents written as page files by executors, one in five deleted again, and scanned."""
    folder = shared_folder(spark, "pages")
    d = _t(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "entities").otherwise("concepts")
    path = page_source.page_path(kind, _slug())
    text_files.write_files(d.select(path.alias("path"), page_source.render_page(_front(("title", F.col("source"))), F.col("text")).alias("text")), folder)
    text_files.write_files(d.where("doc_id % 5 = 0").select(path.alias("path"), F.lit(None).cast("string").alias("text")), folder)
    parsed = page_source.parse_pages(page_source.read_pages(spark, folder))
    return parsed.select("kind_dir", "slug", page_source.front_value("front", "title").alias("title"), _md5("body").alias("body"))


@query("SELECT 'concepts' AS kind_dir, 'doc-' || doc_id AS slug, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE source END AS title FROM documents WHERE doc_id % 2 = 0")
def index_scan(spark, sf_dir):
    """Entries of the index: blank pages count, with their slug as title."""
    d = _t(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n\n"), "text"))
    return page_source.index_entries(page_source.parse_pages(d.select(F.lit("concepts").alias("kind_dir"), _slug().alias("slug"), raw.alias("raw"))))


@query("SELECT * FROM (SELECT 'doc-' || max(doc_id) AS slug, 'concepts' AS kind_dir FROM documents)")
def page_lookup(spark, sf_dir):
    """Every document as a concept and as an entity; the last one's slug is looked up."""
    d = _t(spark, sf_dir, "documents")
    both = d.select(_slug().alias("slug"), F.explode(F.array(F.lit("entities"), F.lit("concepts"))).alias("kind_dir"))
    last = d.agg(F.max("doc_id").alias("doc_id")).select(_slug().alias("wanted"))
    return page_source.find_page(both.join(last, F.col("slug") == F.col("wanted")).drop("wanted"), last.first()["wanted"])


# ---- requests and responses -----------------------------------------------------------------------------------------


def _file(x: str) -> str:
    return f"'---' || {_NL} || 'title: ' || {x}.source || {_NL} || '---' || {_NL} || CASE WHEN {x}.text = '' THEN '' ELSE {_NL} || {x}.text END"


@query(f"""WITH {_COPIES}
SELECT a.doc_id AS a, b.doc_id AS b, md5('doc-' || a.doc_id || ' ' || a.source || {_NL} || {_file("a")} || {_NL} || 'doc-' || b.doc_id || ' ' || b.source || {_NL} || {_file("b")}) AS user
FROM c JOIN documents a ON a.doc_id = c.doc_id JOIN documents b ON b.doc_id = c.b""")
def lint_request(spark, sf_dir):
    """Whether two pages are one, for neighbouring copies, with the whole files."""
    d = _t(spark, sf_dir, "documents")
    pages = d.select(F.lit("concepts").alias("kind_dir"), _slug().alias("slug"), _front(("title", F.col("source"))).alias("front"), F.col("text").alias("body"))
    template = runs.Template("s", "{{ slug_a }} {{ title_a }}\n{{ body_a }}\n{{ slug_b }} {{ title_b }}\n{{ body_b }}")
    made = jobs.maintenance_requests("lint", pages, template, _copies_decided(spark, sf_dir).select("kind_a", "slug_a", "kind_b", "slug_b"))
    number = lambda x: F.substring(f"slug_{x}", 5, 30).cast("long").alias(x)
    return made.select(number("a"), number("b"), _md5("user").alias("user"))


def _stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_as_pages(spark, sf_dir).select("doc_id", F.lit("concepts").alias("kind_dir"), "slug", _front(("title", F.col("title"))).alias("front"), "body")


@query(f"""WITH {_PAGES} SELECT 'doc-' || doc_id AS slug, md5('doc-' || doc_id || ' (concepts) ' || title || {_NL} || {_NL} || body) AS user FROM pages0""")
def audit_request(spark, sf_dir):
    made = jobs.maintenance_requests("audit", _stored_pages(spark, sf_dir), runs.Template("s", "{{ slug }} ({{ page_type }}) {{ title }}\n\n{{ body }}"))
    return made.select("slug", _md5("user").alias("user"))


_TEXT = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {_PAGES}
SELECT 'doc-' || doc_id AS slug, md5(title || ': ' || (1 + doc_id % 3) || list_aggregate([{_NL} || '(' || i || ' of ' || (1 + doc_id % 3) || ') ' || {_TEXT} FOR i IN range(1, CAST(2 + doc_id % 3 AS BIGINT))], 'string_agg', '')) AS user FROM pages0 WHERE doc_id % 3 >= 1""")
def consolidate_request(spark, sf_dir):
    """Pages of two blocks and more, with all their blocks, numbered."""
    template = runs.Template("s", "{{ page_title }}: {{ fragments | length }}{% for f in fragments %}\n({{ loop.index }} of {{ loop.length }}) {{ f }}{% endfor %}")
    made = jobs.maintenance_requests("consolidate", _stored_pages(spark, sf_dir), template)
    return made.select("slug", _md5("user").alias("user"))


@query(f"WITH {_PAGES} SELECT 'doc-' || doc_id AS slug, md5(title || {_NL} || {_TEXT}) AS user FROM pages0")
def rewrite_request(spark, sf_dir):
    made = jobs.maintenance_requests("rewrite", _stored_pages(spark, sf_dir), runs.Template("s", "{{ title }}\n{{ body }}"))
    return made.select("slug", _md5("user").alias("user"))


def _measure(system: str, user: str) -> dict:
    """Stands for a model: says how long the text is, and fails on some."""
    if len(user) % 7 == 0:
        raise RuntimeError("no answer")
    return {"text": f"{len(user)} characters", "input_tokens": len(user.encode())}


@query("SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN length(text) || ' characters' END AS text, CASE WHEN length(text) % 7 <> 0 THEN CAST(strlen(text) AS BIGINT) END AS input_tokens, CASE WHEN length(text) % 7 = 0 THEN 'no answer' END AS error FROM documents")
def response_store(spark, sf_dir):
    """A provider asked once for each text; copies share a request."""
    store = responses.ResponseStore(spark, shared_folder(spark, "responses"))
    asked = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("request_id"), F.lit("s").alias("system"), F.col("text").alias("user"))
    got = store.fill(asked, _measure, tries=1)
    return asked.select("doc_id", "request_id").join(got, "request_id").select("doc_id", "text", "input_tokens", "error")


# ---- transcripts as files and streams -------------------------------------------------------------------------------


def _session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, old, new): turns as transcript lines, as they were and after a compaction that cut their text."""
    line = lambda text: F.to_json(F.struct(F.lit("user").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.struct(F.lit("user").alias("role"), text.alias("content")).alias("message")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", line(F.coalesce("text", F.lit(""))).alias("old"), line(F.lit("cut")).alias("new"))


def _joined(rows: DataFrame, column: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("turn", F.col(column).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(each, lambda x: F.concat(x.line, F.lit("\n"))), "").alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, 'p' || conv_id % 3 AS project, count(*) AS lines FROM conversations GROUP BY conv_id HAVING conv_id % 10 <> 9")
def session_files(spark, sf_dir):
    """Conversations as transcript files by project, listed and scanned; one in ten isn't UTF-8 somewhere, which rejects the file whole."""
    folder = shared_folder(spark, "projects")
    texts = _joined(_session_lines(spark, sf_dir), "old")
    path = F.format_string("p%d/%d.jsonl", F.col("conv_id") % 3, "conv_id")
    text_files.write_files(texts.select(path.alias("path"), "text"), folder)
    listing = transcripts.list_sessions(spark, folder).select("session_id", F.regexp_extract("path", r"/(p\d)/[^/]+$", 1).alias("project"))
    lines = transcripts.read_lines(spark, f"{folder}/p0", f"{folder}/p1", f"{folder}/p2")
    spoiled = lines.withColumn("raw", F.when((F.regexp_extract("path", r"9\.jsonl$", 0) != "") & (F.col("line_no") == 1), F.unhex(F.lit("FF")).cast("string")).otherwise(F.col("raw")))
    events, _ = transcripts.parse_events(transcripts.readable(spoiled)[0])
    return listing.join(events.groupBy("session_id").agg(F.count("*").alias("lines")), "session_id").select("session_id", "project", "lines")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn AS uuid, CASE WHEN turn < 3 THEN md5(coalesce(text, '')) ELSE md5('cut') END AS said, CASE WHEN turn < 2 THEN 1 WHEN turn < 3 THEN 2 ELSE 1073741824 END AS source_rank FROM conversations")
def first_arrivals(spark, sf_dir):
    """Two snapshots of each session and its final transcript, which repeat each other, as a stream: the oldest of each event stands."""
    folder, out = shared_folder(spark, "arrivals"), shared_folder(spark, "arrived")
    lines = _session_lines(spark, sf_dir)
    name = lambda tail: F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit("/"), F.lit(tail))
    files = [_joined(lines.where("turn < 2"), "old").select(name("snapshots/0001.jsonl").alias("path"), "text"), _joined(lines.where("turn < 3"), "old").select(name("snapshots/0002.jsonl").alias("path"), "text")]
    text_files.write_files(files[0].unionByName(files[1]).unionByName(_joined(lines, "new").select(name("session.jsonl").alias("path"), "text")), folder)

    def write(events: DataFrame, rejects: DataFrame, number: int) -> None:
        said = F.try_variant_get("content", "$", "string")
        events.select("session_id", "uuid", _md5(said).alias("said"), "source_rank").write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals.ingest_first(spark, folder, shared_folder(spark, "checkpoint"), write)
    return spark.read.schema("session_id string, uuid string, said string, source_rank int").parquet(f"{out}/batch=*")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of FROM events),
k AS (SELECT *, CASE WHEN n = 1 THEN 'SessionStart' WHEN n = of AND user_id % 2 = 0 THEN 'SessionEnd' WHEN event_type = 'click' THEN 'PreCompact' ELSE 'Stop' END AS event FROM e)
SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event, CASE WHEN event = 'PreCompact' THEN format('{:04d}.jsonl', count(*) FILTER (event = 'PreCompact') OVER w) END AS snapshot,
  count(*) FILTER (event = 'PreCompact') OVER w AS snapshots, first_value('/w/' || event_type) OVER w AS cwd, event <> 'SessionEnd' AS open
FROM k WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)""")
def session_lives(spark, sf_dir):
    """Events of users as the lives of sessions: the first starts one, clicks are compactions, and every other user's last ends it."""
    folder, out = shared_folder(spark, "hooks"), shared_folder(spark, "lives")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").withColumns({"n": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy("user_id"))})
    event = F.when(F.col("n") == 1, "SessionStart").when((F.col("n") == F.col("of")) & (F.col("user_id") % 2 == 0), "SessionEnd").when(F.col("event_type") == "click", "PreCompact").otherwise("Stop")
    hooks = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("transcript_path"), F.concat(F.lit("/w/"), "event_type").alias("cwd"), event.alias("hook_event_name"), F.col("ts").cast("timestamp").alias("at"))
    hooks.write.parquet(folder)
    arrivals.use_state_store(spark)
    lives = lifecycle.session_lives(spark.readStream.schema(hooks.schema).parquet(folder), runs.Config("/vault"), timedelta(days=3650))
    lives.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(lives.schema).parquet(out).select("session_id", F.col("transcript_path").cast("long").alias("event_id"), "event", "snapshot", F.size("snapshots").cast("long").alias("snapshots"), "cwd", "open")


# ---- stores, ledgers and reports ------------------------------------------------------------------------------------


@query(f"""WITH v AS (SELECT doc_id, {_VERDICT} AS verdict FROM labels)
SELECT 'page' AS what, 'doc-' || doc_id AS name, md5(CASE WHEN doc_id % 4 = 1 THEN 'second ' || text ELSE text END) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v WHERE verdict <> 'keep')
UNION ALL SELECT 'entry', split_part(split_part(entry, 'audit | ', 2), chr(10), 1), md5(entry) FROM (
  SELECT chr(10) || '## [2024-02-01] audit | ' || verdict || ' doc-' || doc_id || chr(10) || chr(10) || CASE WHEN verdict = 'delete' THEN 'toxic' ELSE 'poor: ' || doc_id END || chr(10) AS entry FROM v JOIN documents USING (doc_id) WHERE verdict <> 'keep')
UNION ALL SELECT 'file', 'doc-' || doc_id, md5('---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || CASE WHEN t = '' THEN '' ELSE chr(10) || t END) FROM (
  SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'second ' || text ELSE text END AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v WHERE verdict <> 'keep'))""")
def vault_audit(spark, sf_dir):
    """Documents as pages of a store, one in four written again, then audited, each as a transaction; its pages, its log and the exported files."""
    v = vault.Vault(spark, shared_folder(spark, "vault"))
    d = _t(spark, sf_dir, "documents")
    pages = d.select("doc_id", F.lit("concepts").alias("kind_dir"), _slug().alias("slug"), _front(("title", F.col("source"))).alias("front"), F.col("text").alias("body"))
    v.load(pages)
    v.load(pages.where("doc_id % 4 = 1").withColumn("body", F.concat(F.lit("second "), "body")))
    said = F.to_json(F.struct(_verdict().alias("verdict"), F.lit("toxic").alias("reason"), F.concat(F.lit("poor: "), F.col("doc_id").cast("string")).alias("log_line")))
    vault.apply_audit(v, _t(spark, sf_dir, "labels").select(F.lit("concepts").alias("kind_dir"), _slug().alias("slug"), said.alias("text")), _now())
    files = shared_folder(spark, "export")
    v.export(files)
    seen = v.snapshot()
    entry = F.split_part(F.split_part("entry", F.lit("audit | "), F.lit(2)), F.lit("\n"), F.lit(1))
    return (
        seen.pages().select(F.lit("page").alias("what"), F.col("slug").alias("name"), _md5("body").alias("digest"))
        .unionByName(seen.appended("maintenance").select(F.lit("entry").alias("what"), entry.alias("name"), _md5("entry").alias("digest")))
        .unionByName(text_files.read_files(spark, [f"{files}/wiki/concepts"], ".md").select(F.lit("file").alias("what"), F.regexp_extract("name", r"^(.+)\.md$", 1).alias("name"), _md5("text").alias("digest")))
    )


@query("SELECT event_id, '/a/' || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || user_id END AS path, CASE WHEN event_type = 'click' THEN '/a/click' END AS skip_path FROM events")
def canonical_path(spark, sf_dir):
    """Folders spelled with dots and doubled slashes, and the skip path they are below."""
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("/x/..")).otherwise(F.concat(F.lit("//"), F.col("user_id").cast("string"), F.lit("/.")))
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/../a/./b/../"), "event_type", tail).alias("cwd"))
    return sessions.skip_canonical(rows, ["/a//x/../click/"]).select("event_id", paths.canonical("cwd").alias("path"), F.when(F.col("skip_path").isNotNull(), paths.canonical("skip_path")).alias("skip_path"))


@query("""
SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN 'payload too large' WHEN event_id % 5 = 1 THEN 'missing cwd' WHEN event_id % 5 = 2 THEN 'missing session_id, transcript_path, cwd, hook_event_name' END AS error,
  CASE WHEN event_id % 1000 <> 0 AND event_id % 5 <> 2 THEN CAST(user_id AS VARCHAR) END AS session_id FROM events""")
def payload_check(spark, sf_dir):
    """Hook payloads: one in a thousand is over a mebibyte, one in five lacks a field, one in five is no JSON."""
    n = F.col("event_id") % 5
    whole = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.lit("/t").alias("transcript_path"), F.when(n != 1, "/w").alias("cwd"), F.lit("Stop").alias("hook_event_name"), "props"))
    raw = F.when(F.col("event_id") % 1000 == 0, F.rpad(whole, runs.MAX_PAYLOAD_BYTES + 1, " ")).when(n == 2, F.lit("{oops")).otherwise(whole)
    return runs.parse_payloads(_t(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "event_id").select("event_id", "error", "session_id")


@query(f"""
SELECT strftime(min(ts), '%Y-%m-%dT%H-%M') || '_' || left('user-' || user_id, 12) || '.md' AS name,
  md5('---' || {_NL} || 'title: T' || user_id || {_NL} || 'type: source' || {_NL} || 'created: ' || strftime(min(ts), '%Y-%m-%d') || {_NL} || CASE WHEN user_id % 2 = 0 THEN 'tags:' || {_NL} || '  - a' || {_NL} || '  - b' ELSE 'tags: []' END || {_NL} || '---' || {_NL} || {_NL}
  || '# T' || user_id || {_NL} || {_NL} || 'Raw session transcript (JSONL).' || {_NL} || {_NL} || '```jsonl' || {_NL} || CASE WHEN user_id % 3 = 0 THEN '' ELSE string_agg(props, {_NL} ORDER BY event_id) END || {_NL} || '```' || {_NL}) AS text
FROM events GROUP BY user_id""")
def raw_copy(spark, sf_dir):
    """Users' events as transcripts, one in three unreadable, copied for reading."""
    e = _t(spark, sf_dir, "events")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x.props), "\n")
    u = F.col("user_id")
    rows = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), lines.alias("raw"))
    rows = rows.select(F.concat(F.lit("user-"), u.cast("string")).alias("session_id"), F.col("started_at").cast("timestamp"), F.when(u % 3 != 0, F.col("raw")).alias("raw"), F.concat(F.lit("T"), u.cast("string")).alias("title"), F.when(u % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return sinks.raw_copies(rows).select("name", _md5("text").alias("text"))


@query("SELECT format('{:04d}.jsonl', 1 + max(doc_id) FILTER (doc_id % 2 = 0)) AS name FROM documents")
def next_snapshot_name(spark, sf_dir):
    """Odd documents' files aren't snapshots."""
    names = _t(spark, sf_dir, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.when(F.col("doc_id") % 2 == 0, ".jsonl").otherwise(".json")).alias("name"))
    return sinks.next_snapshot(names)


@query(f"""
WITH r AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{NOW}') - epoch(ts)) AS BIGINT) AS s FROM events ORDER BY event_id DESC LIMIT 50)
SELECT event_id AS line_no, CASE WHEN event_type = 'error' THEN '✗' ELSE '✓' END AS icon, s // 86400 AS days, left('session-' || user_id, 8) AS session, CASE WHEN event_type = 'error' THEN left('failed on ' || repeat(props, 20), 120) END AS error,
  CASE WHEN event_type <> 'error' THEN 'tokens: ' || user_id || ' in / ' || event_id || ' out' END AS tokens FROM r""")
def run_status(spark, sf_dir):
    """The report on the last fifty runs."""
    e, bad = _t(spark, sf_dir, "events"), F.col("event_type") == "error"
    rows = e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("finished_at"), F.array().cast("array<string>").alias("touched_pages"), F.when(bad, F.concat(F.lit("failed on "), F.repeat("props", 20))).alias("error"), F.when(~bad, F.col("user_id")).alias("input_tokens"), F.when(~bad, F.col("event_id")).alias("output_tokens"))
    got = sinks.status_rows(rows, _now(), 50)
    days = F.floor((F.unix_timestamp(_now()) - F.unix_timestamp("started_at")) / 86400).cast("long")
    return got.join(rows.select("line_no", days.alias("days")), "line_no").select("line_no", "icon", "days", "session", "error", "tokens")


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR)) AS n, count(*) OVER () AS of FROM (SELECT DISTINCT user_id FROM events)")
def run_progress(spark, sf_dir):
    """Sessions numbered in the order in which a replay takes them."""
    listing = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct().withColumn("path", F.lit("p"))
    return jobs.progress(listing).select("session_id", "n", "of")
