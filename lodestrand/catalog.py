"""The query catalog over the driver's tables, with the SQL each query must equal.

The tables hold no transcripts, pages or responses, so each query first derives them from a table, whole, and then
applies the library's operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import sets, text, times
from lodestrand.operators import near_pages, pages, requests, sessions
from lodestrand.plans import jobs
from lodestrand.sources import pages as page_source
from lodestrand.sources import runs, sinks, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FMT = text.PageFormat()
NOW = "2024-02-01 12:00:00"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now() -> Column:
    return F.to_timestamp(F.lit(NOW))


# ---- derived tables -------------------------------------------------------------------------------------------------


def turns_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as parsed transcript events."""
    c = _t(spark, sf_dir, "conversations")
    body = F.coalesce("text", F.lit(""))
    lines = c.select(
        F.lit(1).alias("source_rank"), F.col("turn").cast("int").alias("line_no"),
        F.to_json(F.struct(
            F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.concat_ws("-", "conv_id", "turn").alias("uuid"),
            F.concat(F.lit("2026-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z")).alias("timestamp"),
            F.when(F.col("role") == "user", F.concat(F.lit("/work/"), F.col("conv_id").cast("string"))).alias("cwd"), F.when(F.col("role") == "system", "note").alias("subtype"),
            F.when(F.col("role") != "system", F.struct(
                F.col("role").alias("role"), F.when(F.col("role") == "assistant", F.when(F.col("turn") % 5 == 3, sessions.SYNTHETIC_MODEL).otherwise(F.concat(F.lit("m"), (F.col("turn") % 3).cast("string")))).alias("model"),
                F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))).alias("content"), F.struct(F.length(body).alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"),
            )).alias("message"),
        )).alias("raw"),
    )
    return transcripts.parse_events(lines)[0]


def docs_as_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(F.when(F.col("lang").isin("en", "fr"), "entities").otherwise("concepts").alias("kind_dir"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.concat_ws(" ", "source", "doc_id").alias("title"), text.truncate_chars(text.collapse_whitespace("text")).alias("summary"))


_TOPICS = """topics AS (SELECT CASE WHEN lang IN ('en', 'fr') THEN 'entities' ELSE 'concepts' END AS kind_dir, 'doc-' || doc_id AS slug,
  source || ' ' || doc_id AS title, doc_id,
  CASE WHEN length(c) > 400 THEN left(c, 399) || '…' ELSE c END AS summary
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents))"""


def docs_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one to three blocks, between an introduction and a footer."""
    d = _t(spark, sf_dir, "documents")
    block = lambda i: F.concat(F.lit(f"{FMT.open}b{i} -->\n"), "text", F.lit(f"\n{FMT.close}\n"))
    body = F.concat(F.lit("# "), "source", F.lit("\n\n"), *[F.when(F.col("doc_id") % 3 >= i, block(i)).otherwise("") for i in range(3)], F.lit("footer\n"))
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.col("source").alias("title"), "text", body.alias("body"))


_PAGES = """pages0 AS (SELECT doc_id, 'doc-' || doc_id AS slug, source AS title, text, '# ' || source || chr(10) || chr(10)
  || list_aggregate([CASE WHEN doc_id % 3 >= i THEN '<!-- engine:fact id=b' || i || ' -->' || chr(10) || text || chr(10) || '<!-- engine:end -->' || chr(10) ELSE '' END FOR i IN [0, 1, 2]], 'string_agg', '')
  || 'footer' || chr(10) AS body FROM documents)"""
_FACT_ID = "left(sha256(left({slug} || ':' || {summary}, 80)), 8)"


# ---- sessions -------------------------------------------------------------------------------------------------------


@query("""
SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_min('/work/' || conv_id, turn) FILTER (role = 'user') AS cwd,
  TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(min(turn % 60) AS BIGINT)) AS started_at, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(max(turn % 60) AS BIGINT)) AS ended_at,
  arg_max('m' || (turn % 3), turn) FILTER (role = 'assistant' AND turn % 5 <> 3) AS model,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN turn ELSE 0 END) AS BIGINT) AS output_tokens, count(*) AS event_count
FROM conversations GROUP BY conv_id""")
def session_metadata(spark, sf_dir):
    got = sessions.session_metadata(turns_as_events(spark, sf_dir))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS line_no, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def conversation_filter(spark, sf_dir):
    return sessions.reconstruct(turns_as_events(spark, sf_dir))[0].select("session_id", "line_no", "role", "content")


def events_as_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assistant turns of their users: the event type as model, errors being synthetic, and as folder but for views; props as usage."""
    e = _t(spark, sf_dir, "events")
    kind, props = F.col("event_type"), F.regexp_replace("props", '"k"', '"input_tokens"')
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.lit(1).alias("source_rank"), F.col("event_id").alias("line_no"), F.lit("assistant").alias("type"), F.when(kind != "view", kind).alias("cwd"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "error", sessions.SYNTHETIC_MODEL).otherwise(kind).alias("model"), F.try_parse_json(props).alias("usage"),
    )


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS last_type FROM events GROUP BY user_id")
def last_value_by_position(spark, sf_dir):
    return sessions.session_metadata(events_as_turns(spark, sf_dir)).select("session_id", F.col("model").alias("last_type"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS first_type FROM events GROUP BY user_id")
def first_value_by_position(spark, sf_dir):
    return sessions.session_metadata(events_as_turns(spark, sf_dir)).select("session_id", F.col("cwd").alias("first_type"))


@query("""
WITH u AS (SELECT *, 2 AS source_rank, CAST(event_id AS VARCHAR) AS uuid FROM events
  UNION ALL SELECT * REPLACE (value * 2 AS value), 1, CASE WHEN event_id % 3 = 1 THEN NULL ELSE CAST(event_id AS VARCHAR) END FROM events WHERE event_id % 3 <> 0)
SELECT user_id, event_id, source_rank, value FROM u QUALIFY uuid IS NULL OR row_number() OVER (PARTITION BY user_id, uuid ORDER BY source_rank) = 1""")
def snapshot_priority_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), "value", F.col("ts").cast("string").alias("ts_raw"), F.col("event_id").cast("string").alias("uuid"))
    old = e.where(F.col("line_no") % 3 != 0).withColumns({"value": F.col("value") * 2, "uuid": F.when(F.col("line_no") % 3 != 1, F.col("uuid"))})
    rows = e.withColumn("source_rank", F.lit(2)).unionByName(old.withColumn("source_rank", F.lit(1)))
    return sessions.merge_snapshots(rows).select(F.col("session_id").alias("user_id"), F.col("line_no").alias("event_id"), "source_rank", "value")


@query("""
SELECT s.event_id, s.user_id, p.value FROM events s LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) p USING (user_id)
WHERE s.event_type = 'signup'""")
def left_pairing_last_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return sessions.pair_last_wins(e.where("event_type = 'signup'").select("event_id", "user_id"), e.where("event_type = 'purchase'"), ["user_id"], "event_id", "value")


@query("""
SELECT CAST(user_id AS VARCHAR) AS session_id, 'call-' || event_id AS tool_use_id, event_type AS name, CAST(json_object('k', CAST(props->>'$.k' AS INTEGER)) AS VARCHAR) AS input,
  CASE WHEN event_id % 4 <> 0 THEN 'value ' || event_id || CASE WHEN event_id % 4 = 2 THEN ' again' ELSE '' END END AS output FROM events""")
def tool_call_pairing(spark, sf_dir):
    """Every event as a tool use; three in four get a result, one in four a second one, which stands."""
    e = _t(spark, sf_dir, "events")
    ident = F.concat(F.lit("call-"), F.col("event_id").cast("string"))
    base = lambda kind, rank, content: e.select(F.lit(rank).alias("source_rank"), F.col("event_id").cast("int").alias("line_no"), "event_id", F.to_json(F.struct(F.lit(kind).alias("type"), F.col("user_id").cast("string").alias("sessionId"), F.struct(F.lit(kind).alias("role"), content.alias("content")).alias("message"))).alias("raw"))
    use = F.array(F.struct(F.lit("tool_use").alias("type"), ident.alias("id"), F.col("event_type").alias("name"), F.from_json("props", "k int").alias("input")))
    result = lambda tail: F.array(F.struct(F.lit("tool_result").alias("type"), ident.alias("tool_use_id"), F.concat(F.lit("value "), F.col("event_id").cast("string"), F.lit(tail)).alias("content")))
    lines = base("assistant", 1, use).unionByName(base("user", 2, result("")).where("event_id % 4 <> 0")).unionByName(base("user", 3, result(" again")).where("event_id % 4 = 2"))
    return sessions.reconstruct(transcripts.parse_events(lines.drop("event_id"))[0])[1].select("session_id", "tool_use_id", "name", "input", "output")


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(sum(greatest(CAST(props->>'$.k' AS BIGINT), 0)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY user_id")
def json_usage_sum(spark, sf_dir):
    return sessions.session_metadata(events_as_turns(spark, sf_dir)).select("session_id", F.col("input_tokens").alias("k_sum"), F.col("event_count").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'not JSON' WHEN event_type = 'view' THEN 'unknown type' WHEN event_type = 'click' THEN 'missing or ill-typed field' END AS reason FROM events""")
def json_reject_split(spark, sf_dir):
    """Events as lines: errors are no JSON, views of an unknown type, clicks have a number for their session."""
    e = _t(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.lit("last-prompt").alias("type"), F.col("user_id").cast("string").alias("sessionId"), F.col("props").alias("lastPrompt")))
    bad = F.to_json(F.struct(F.lit("last-prompt").alias("type"), F.col("user_id").alias("sessionId"), F.col("props").alias("lastPrompt")))
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), good)).when(F.col("event_type") == "view", F.replace(good, F.lit("last-prompt"), F.lit("first-prompt"))).when(F.col("event_type") == "click", bad).otherwise(good)
    events, rejects = transcripts.parse_events(e.select(F.col("event_id").alias("line_no"), raw.alias("raw")))
    return events.select(F.col("line_no").alias("event_id"), F.lit(None).cast("string").alias("reason")).unionByName(rejects.select(F.col("line_no").alias("event_id"), "reason"))


@query("SELECT user_id, max(ts) AS modified FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-29'")
def mtime_style_cut(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("modified")).where(F.col("modified") >= F.lit("2024-01-29").cast("timestamp_ntz")).orderBy("user_id")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS cwd FROM pages)
SELECT page_id, cwd, CASE WHEN cwd = '/en' OR starts_with(cwd, '/en/') THEN '/en' WHEN cwd = '/fr' OR starts_with(cwd, '/fr/') THEN '/fr/' END AS skip_path FROM p""")
def path_prefix_filter(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("cwd"))
    return sessions.skip_reason(p, ["/en", "/fr/", "/en/25"])


# ---- strings --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[-_\\s]+', ' ', 'g'))) AS normal FROM documents")
def normalize_slug(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize("text").cast("binary")).alias("normal"))


@query(f"WITH {_TOPICS} SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, (SELECT summary FROM topics t WHERE t.doc_id = documents.doc_id) AS summary FROM documents")
def summary_400(spark, sf_dir):
    one = text.collapse_whitespace("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(one.cast("binary")).alias("collapsed"), text.truncate_chars(one).alias("summary"))


@query("""
SELECT doc_id, md5(CASE WHEN strlen(text) <= 8192 THEN text ELSE
  CASE WHEN strlen(left(text, n)) = 0 THEN '' ELSE left(text, n) END || chr(10) || '[... truncated, original was ' || strlen(text) || ' bytes]' END) AS capped
FROM (SELECT *, CASE WHEN strlen(text) > 8192 THEN list_max(list_filter(range(2048, 8193), lambda i: strlen(left(text, CAST(i AS INTEGER))) <= 8192)) END AS n FROM documents)""")
def byte_cap_truncate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate_bytes("text", text.USER_CAP).cast("binary")).alias("capped"))


@query("SELECT doc_id, " + _FACT_ID.format(slug="(source || '-' || doc_id)", summary="trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))") + " AS fact_id FROM documents")
def fact_id(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.fact_id(F.concat_ws("-", "source", "doc_id"), "text").alias("fact_id"))


@query(f"""WITH {_PAGES}
SELECT doc_id, i - 1 AS ord, ids[i] AS id, md5(regexp_replace(bodies[i], '^\\s+|\\s+$', '', 'g')) AS body FROM (
  SELECT doc_id, regexp_extract_all(body, '(?s)<!-- engine:fact id=(.*?) -->(.*?)<!-- engine:end -->', 1) AS ids, regexp_extract_all(body, '(?s)<!-- engine:fact id=(.*?) -->(.*?)<!-- engine:end -->', 2) AS bodies FROM pages0),
  range(1, 4) r(i) WHERE i <= len(ids)""")
def block_extract(spark, sf_dir):
    each = docs_as_pages(spark, sf_dir).select("doc_id", F.posexplode(FMT.blocks("body")).alias("ord", "b"))
    return each.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("b.id").alias("id"), F.md5(F.col("b.body").cast("binary")).alias("body"))


@query(f"""WITH {_PAGES}, b AS (SELECT *, '<!-- engine:fact id=b1 -->' AS o, '<!-- engine:fact id=b1 -->' || chr(10) || 'new text' || chr(10) || '<!-- engine:end -->' AS n FROM pages0)
SELECT doc_id, md5(CASE WHEN strpos(body, o) > 0 THEN left(body, strpos(body, o) - 1) || n || substr(substr(body, strpos(body, o)), strpos(substr(body, strpos(body, o)), '<!-- engine:end -->') + 19)
  ELSE rtrim(body, chr(10)) || chr(10) || chr(10) || n || chr(10) END) AS body FROM b""")
def block_upsert(spark, sf_dir):
    return docs_as_pages(spark, sf_dir).select("doc_id", F.md5(FMT.upsert("body", F.lit("b1"), F.lit("new text")).cast("binary")).alias("body"))


@query("""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '<!-- ENGINE-INDEX-START -->old<!-- ENGINE-INDEX-END -->' || chr(10) || text ELSE text END AS page FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN replace(page, '-->old<!--', '-->' || 'fresh' || '<!--')
  ELSE page || CASE WHEN page LIKE '%' || chr(10) THEN '' ELSE chr(10) END || chr(10) || '<!-- ENGINE-INDEX-START -->fresh<!-- ENGINE-INDEX-END -->' || chr(10) END) AS page FROM p""")
def managed_region(spark, sf_dir):
    a, b = FMT.region
    page = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(f"{a}old{b}\n"), "text")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(FMT.replace_region(page, F.lit("fresh")).cast("binary")).alias("page"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, md5('## ' || strftime(ts, '%Y-%m-%d') || chr(10) || chr(10) || string_agg('- ' || strftime(ts, '%H:%M') || ' ' || event_type || ' → [[user/' || user_id || ']] [[event/' || event_id || ']]', chr(10) ORDER BY ts, event_id) || chr(10)) AS section
FROM events GROUP BY 1""")
def heading_log(spark, sf_dir):
    links = F.array(F.concat(F.lit("user/"), F.col("user_id").cast("string")), F.concat(F.lit("event/"), F.col("event_id").cast("string")))
    rows = _t(spark, sf_dir, "events").select("ts", F.col("event_id").alias("ord"), F.col("event_type").alias("title"), links.alias("touched"))
    return sinks.render_log(rows).select("day", F.md5(F.col("section").cast("binary")).alias("section"))


@query("""
WITH d AS (SELECT doc_id, '# Log' || chr(10) || chr(10) || '## 2024-01-0' || (1 + doc_id % 3) || chr(10) || chr(10) || '- 09:00 ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## 2024-01-09' || chr(10) || chr(10) || '- late' || chr(10) ELSE '' END AS log FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN rtrim(log, chr(10)) || chr(10) || chr(10) || '## 2024-01-02' || chr(10) || chr(10) || '- new' || chr(10)
  WHEN doc_id % 2 = 0 THEN replace(log, chr(10) || chr(10) || '## 2024-01-09', chr(10) || '- new' || chr(10) || chr(10) || '## 2024-01-09') ELSE rtrim(log, chr(10)) || chr(10) || '- new' || chr(10) END AS log FROM d""")
def log_section_insert(spark, sf_dir):
    late = F.when(F.col("doc_id") % 2 == 0, "\n## 2024-01-09\n\n- late\n").otherwise("")
    log = F.concat(F.lit("# Log\n\n## 2024-01-0"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("\n\n- 09:00 "), "source", F.lit("\n"), late)
    return _t(spark, sf_dir, "documents").select("doc_id", text.insert_under_heading(log, F.lit("## 2024-01-02"), F.lit("- new")).alias("log"))


@query(f"""WITH {_TOPICS}
SELECT md5(chr(10) || '## Projects (entities)' || chr(10) || chr(10) || (SELECT string_agg('- [[entities/' || slug || ']] · ' || title || chr(10), '' ORDER BY title, slug) FROM topics WHERE kind_dir = 'entities')
  || chr(10) || '## Concepts' || chr(10) || chr(10) || (SELECT string_agg('- [[concepts/' || slug || ']] · ' || title || chr(10), '' ORDER BY title, slug) FROM topics WHERE kind_dir = 'concepts') || chr(10)) AS inside""")
def grouped_index(spark, sf_dir):
    return sinks.render_index(docs_as_topics(spark, sf_dir)).select(F.md5(F.col("inside").cast("binary")).alias("inside"))


@query("""
WITH t AS (SELECT doc_id, 'p' || (doc_id % 7) AS a, source, lang, text FROM documents)
SELECT doc_id, 'doc-' || doc_id AS slug, CASE WHEN doc_id % 5 = 0 THEN 'doc-' || doc_id ELSE source END AS title, CASE WHEN length(c) > 400 THEN left(c, 399) || '…' ELSE c END AS summary
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM t)""")
def topic_scan(spark, sf_dir):
    """Documents as raw pages; every fifth has no title of its own."""
    d = _t(spark, sf_dir, "documents")
    front = F.concat(F.lit("---\n"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("title: "), "source", F.lit("\n"))).otherwise(""), F.lit("tags:\n- a\n- b\nowner: me\n---\n"))
    raw = F.concat(front, F.lit(f"# {0}\n\n{FMT.open}x -->\n"), "text", F.lit(f"\n{FMT.close}\n"))
    parsed = page_source.parse_pages(d.select("doc_id", F.lit("concepts").alias("kind_dir"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), raw.alias("raw")))
    return page_source.topics(parsed).select(F.regexp_extract("slug", r"(\d+)", 1).cast("long").alias("doc_id"), "slug", "title", "summary")


# ---- sets and similarity --------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber <> 2) AS s, list(CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber <> 3) AS c, list(CAST(l_partkey AS VARCHAR)) FILTER (l_linenumber % 2 = 1) AS a FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey, coalesce(s, []) AS s, coalesce(c, []) AS c, coalesce(a, []) AS a FROM o)
SELECT l_orderkey, list_aggregate(list_sort(list_filter(list_distinct(list_concat(a, list_filter(c, lambda x: NOT list_contains(s, x)))), lambda x: NOT list_contains(list_filter(s, lambda y: NOT list_contains(c, y)), x))), 'string_agg', ',') AS merged FROM n""")
def three_way_set_merge(spark, sf_dir):
    part = lambda test: F.collect_list(F.when(test, F.col("l_partkey").cast("string")))
    n = F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(part(n != 2).alias("s"), part(n != 3).alias("c"), part(n % 2 == 1).alias("a"))
    merged = sets.three_way_merge("s", "c", "a")
    return rows.select("l_orderkey", F.when(F.size(merged) > 0, F.array_join(merged, ",")).alias("merged"))


_PAIRED = """d AS (SELECT doc_id, text FROM documents), p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


@query(f"""WITH {_PAIRED}, s AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_split_to_array(x, '[^A-Za-z0-9_-]+'), lambda w: length(w) >= 3), lambda w: lower(w))) AS a,
  list_distinct(list_transform(list_filter(regexp_split_to_array(y, '[^A-Za-z0-9_-]+'), lambda w: length(w) >= 3), lambda w: lower(w))) AS b FROM p)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(a) + len(b) - len(list_intersect(a, b)) AS INTEGER) AS either FROM s""")
def jaccard_word(spark, sf_dir):
    both, either = text.overlap("a", "b")
    return _paired(spark, sf_dir).select("doc_id", text.word_set("text").alias("a"), text.word_set("other").alias("b")).select("doc_id", both.alias("both"), either.alias("either"))


_BIGRAMS = "list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, CAST(i AS INTEGER), 2)))"


@query(f"""WITH {_PAIRED}, q AS (SELECT doc_id, regexp_replace(lower(x), '\\s+', '', 'g') AS u, regexp_replace(lower(y), '\\s+', '', 'g') AS v FROM p), s AS (SELECT doc_id, {_BIGRAMS.format(s="u")} AS a, {_BIGRAMS.format(s="v")} AS b FROM q)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(a) + len(b) - len(list_intersect(a, b)) AS INTEGER) AS either FROM s""")
def jaccard_bigram(spark, sf_dir):
    both, either = text.overlap("a", "b")
    return _paired(spark, sf_dir).select("doc_id", text.bigram_set("text").alias("a"), text.bigram_set("other").alias("b")).select("doc_id", both.alias("both"), either.alias("either"))


#: Stand-ins for letters, as the tables hold no such script.
_CJK = "原子写文件缓存并发索引会话工具结果页面主题合并重复标题摘要"[:26]
_AS_CJK = f"translate(lower({{s}}), 'abcdefghijklmnopqrstuvwxyz', '{_CJK}')"
_HAN = "list_distinct(list_filter(string_split({s}, ''), lambda c: c <> '' AND unicode(c) BETWEEN 19968 AND 40959))"


@query(f"""WITH {_PAIRED}, s AS (SELECT doc_id, {_HAN.format(s=_AS_CJK.format(s="x"))} AS a, {_HAN.format(s=_AS_CJK.format(s="y"))} AS b FROM p)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(a) + len(b) - len(list_intersect(a, b)) AS INTEGER) AS either FROM s""")
def cjk_jaccard(spark, sf_dir):
    both, either = text.overlap("a", "b")
    as_cjk = lambda c: F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", _CJK)
    return _paired(spark, sf_dir).select("doc_id", text.cjk_set(as_cjk("text")).alias("a"), text.cjk_set(as_cjk("other")).alias("b")).select("doc_id", both.alias("both"), either.alias("either"))


#: Letters beyond ASCII in the tables; the oracle's edit distance counts bytes, so it sees single bytes in their place.
_LETTERS = "ßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({i})" for i in range(1, 12) if i not in (9, 10)) + " || chr(14) || chr(15)"
_EDIT = f"levenshtein(translate({{a}}, '{_LETTERS}', {_BYTES}), translate({{b}}, '{_LETTERS}', {_BYTES}))"


@query(f"""WITH f AS (SELECT doc_id, lang, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[-_\\s]+', ' ', 'g')) AS t, md5(CAST(doc_id AS VARCHAR)) AS slug FROM documents),
u AS (SELECT DISTINCT lang, t FROM f), s AS (SELECT a.lang, a.t AS x, b.t AS y, greatest(length(a.t), length(b.t)) AS m, CASE WHEN a.t = b.t THEN 0 WHEN 4 * least(length(a.t), length(b.t)) >= 3 * greatest(length(a.t), length(b.t)) THEN {_EDIT.format(a="a.t", b="b.t")} END AS d FROM u a JOIN u b ON a.lang = b.lang),
best AS (SELECT f.doc_id, g.slug, CASE WHEN m = 0 THEN 1.0 ELSE 1 - CAST(d AS DOUBLE) / m END AS score FROM s JOIN f ON f.lang = s.lang AND f.t = x JOIN f g ON g.lang = s.lang AND g.t = y WHERE f.doc_id <> g.doc_id AND d IS NOT NULL AND (m = 0 OR 4 * (m - d) >= 3 * m))
SELECT f.doc_id, round(max(score), 9) AS match_score, arg_min(best.slug, (-score, best.slug)) AS match_slug FROM f LEFT JOIN best USING (doc_id) GROUP BY f.doc_id""")
def levenshtein_argmax(spark, sf_dir):
    """The most similar other first line of each document's, within its language. Slugs are digests, which are never alike."""
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    facts = d.select("doc_id", F.col("lang").alias("kind_dir"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("page_slug"), F.get(F.split("text", "\n"), F.lit(0)).alias("page_title"))
    found = pages.fuzzy_pages(facts, facts.select("kind_dir", F.col("page_slug").alias("slug"), F.col("page_title").alias("title")))
    return found.select("doc_id", F.round("match_score", 9).alias("match_score"), "match_slug")


_WORDS = "list_distinct(list_transform(list_filter(regexp_split_to_array(summary, '[^A-Za-z0-9_-]+'), lambda w: length(w) >= 3), lambda w: lower(w)))"
_NEAR = f"""WITH {_TOPICS}, n AS (SELECT kind_dir, slug, regexp_replace(lower(slug), '[-_\\s]+', ' ', 'g') AS s, trim(regexp_replace(lower(title), '[-_\\s]+', ' ', 'g')) AS t, {_WORDS} AS w, regexp_replace(lower(summary), '\\s+', '', 'g') AS u FROM topics),
g AS (SELECT *, {_BIGRAMS.format(s="u")} AS b FROM n),
p AS (SELECT x.kind_dir AS kind_a, x.slug AS slug_a, y.kind_dir AS kind_b, y.slug AS slug_b, {_EDIT.format(a="x.s", b="y.s")} AS ds, greatest(length(x.s), length(y.s)) AS ms,
  {_EDIT.format(a="x.t", b="y.t")} AS dt, greatest(length(x.t), length(y.t)) AS mt, len(list_intersect(x.b, y.b)) AS ib, len(x.b) + len(y.b) AS nb, len(list_intersect(x.w, y.w)) AS iw, len(x.w) + len(y.w) AS nw
  FROM g x JOIN g y ON (x.slug, x.kind_dir) < (y.slug, y.kind_dir)),
r AS (SELECT *, CASE WHEN ms = 0 THEN 1.0 ELSE 1 - CAST(ds AS DOUBLE) / ms END AS slug_score, CASE WHEN mt = 0 THEN 1.0 ELSE 1 - CAST(dt AS DOUBLE) / mt END AS title_score,
  CASE WHEN nb = ib THEN 0.0 ELSE CAST(ib AS DOUBLE) / (nb - ib) END AS bigram_score, CASE WHEN nw = iw THEN 0.0 ELSE CAST(iw AS DOUBLE) / (nw - iw) END AS word_score FROM p
  WHERE ms = 0 OR 20 * (ms - ds) >= 13 * ms OR mt = 0 OR 20 * (mt - dt) >= 13 * mt OR (ib > 0 AND 5 * ib >= nb - ib) OR (iw > 0 AND 10 * iw >= 3 * (nw - iw)))
SELECT kind_a, slug_a, kind_b, slug_b, round(slug_score, 9) AS slug_score, round(title_score, 9) AS title_score, round(bigram_score, 9) AS bigram_score, CAST(0 AS DOUBLE) AS cjk_score,
  round(word_score, 9) AS word_score, round(greatest(slug_score, title_score, bigram_score, word_score), 9) AS score FROM r"""


@query(_NEAR)
def near_dup_pairs(spark, sf_dir):
    return near_pages.near_pairs(docs_as_topics(spark, sf_dir), places=9)


@query(_NEAR)
def near_dup_pairs_blocked(spark, sf_dir):
    return near_pages.near_pairs_blocked(docs_as_topics(spark, sf_dir), places=9)


# ---- resolution, verdicts, maintenance ------------------------------------------------------------------------------


def _facts_and_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    facts = d.select("doc_id", F.lit("entity").alias("kind"), F.col("doc_id").cast("string").alias("page_slug"))
    return facts, labels.select(F.lit("entities").alias("kind_dir"), F.col("doc_id").cast("string").alias("slug"))


@query("SELECT doc_id, 'wiki/entities/' || doc_id || '.md' AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exact_page_semi(spark, sf_dir):
    return pages.exact_pages(*_facts_and_pages(spark, sf_dir))[0].select("doc_id", page_source.page_path("kind_dir", "page_slug").alias("path"))


@query("SELECT doc_id, 'entities/' || doc_id AS link FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exact_page_anti(spark, sf_dir):
    return pages.exact_pages(*_facts_and_pages(spark, sf_dir))[1].select("doc_id", page_source.log_link(page_source.page_path("kind_dir", "page_slug")).alias("link"))


def _verdict() -> Column:
    return F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "move-to-log").otherwise("keep")


_VERDICT = "CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 0 THEN 'move-to-log' ELSE 'keep' END"


@query(f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM labels GROUP BY 1")
def verdict_counts(spark, sf_dir):
    decided = _t(spark, sf_dir, "labels").select(_verdict().alias("verdict"))
    return jobs.verdict_report(decided).withColumnRenamed("count", "n")


@query(f"""WITH v AS (SELECT doc_id, {_VERDICT} AS verdict FROM labels)
SELECT doc_id, NULL AS entry FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v WHERE verdict <> 'keep')
UNION ALL SELECT doc_id, chr(10) || '## [2024-02-01] audit | ' || verdict || ' ' || doc_id || chr(10) || chr(10) || CASE WHEN verdict = 'delete' THEN 'toxic' ELSE 'poor: ' || doc_id END || chr(10) FROM v JOIN documents USING (doc_id) WHERE verdict <> 'keep'""")
def apply_verdict(spark, sf_dir):
    slug = F.col("doc_id").cast("string").alias("slug")
    d = _t(spark, sf_dir, "documents").select(F.lit("concepts").alias("kind_dir"), slug)
    v = _t(spark, sf_dir, "labels").select(F.lit("concepts").alias("kind_dir"), slug, _verdict().alias("verdict"), F.lit("toxic").alias("reason"), F.concat(F.lit("poor: "), F.col("doc_id").cast("string")).alias("log_line"))
    left, entries = pages.audit(d, v, _now())
    return left.select(F.col("slug").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("entry")).unionByName(entries.select(F.col("slug").cast("long").alias("doc_id"), "entry"))


def _copies_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring copies as decided merges whose winner is the first copy: later pairs of a chain meet a page that is gone or lost."""
    w = Window.partitionBy("text").orderBy("doc_id")
    d = _t(spark, sf_dir, "documents").withColumns({"b": F.lead("doc_id").over(w), "first": F.min("doc_id").over(Window.partitionBy("text"))}).where("b IS NOT NULL")
    slug = lambda c: F.concat(F.lit("doc-"), F.col(c).cast("string"))
    return d.select(F.col("doc_id").alias("ord"), F.lit("concepts").alias("kind_a"), slug("doc_id").alias("slug_a"), F.lit("concepts").alias("kind_b"), slug("b").alias("slug_b"), F.lit("merge").alias("verdict"), slug("first").alias("winner"), F.lit(" one text\n").alias("merged_body"), F.lit("copies").alias("reason"))


@query("""
WITH c AS (SELECT doc_id, lead(doc_id) OVER w AS b, row_number() OVER w AS nth FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id))
SELECT doc_id AS ord, 'doc-' || doc_id AS winner_slug, 'doc-' || b AS loser_slug FROM c WHERE b IS NOT NULL AND nth = 1""")
def merge_fold_killset(spark, sf_dir):
    return near_pages.killset_fold(_copies_decided(spark, sf_dir)).select("ord", "winner_slug", "loser_slug")


_COPIES = """c AS (SELECT doc_id, text, lead(doc_id) OVER w AS b, row_number() OVER w AS nth FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)),
m AS (SELECT doc_id AS winner, b AS loser FROM c WHERE b IS NOT NULL AND nth = 1)"""


@query(f"""WITH {_COPIES}
SELECT 'concepts' AS kind_dir, 'doc-' || doc_id AS slug, CASE WHEN doc_id IN (SELECT winner FROM m) THEN '2024-02-01' ELSE '2020-01-01' END AS updated,
  md5(CASE WHEN doc_id IN (SELECT winner FROM m) THEN '# ' || source || chr(10) || chr(10) || '<!-- engine:fact id=' || {_FACT_ID.format(slug="'doc-' || doc_id", summary="'lint-merged@2024-02-01'")} || ' -->' || chr(10) || 'one text' || chr(10) || '<!-- engine:end -->' || chr(10) ELSE text END) AS body
FROM documents WHERE doc_id NOT IN (SELECT loser FROM m)
UNION ALL SELECT 'entities', 'doc-' || doc_id, '2020-01-01', md5(text) FROM documents""")
def apply_merge(spark, sf_dir):
    """Copies merged, with an entity page of every concept page's slug, which no merge touches."""
    front = F.to_json(F.array(F.array(F.lit("title"), F.col("source")), F.array(F.lit("updated"), F.lit("2020-01-01")), F.array(F.lit("owner"), F.lit("me"))))
    d = _t(spark, sf_dir, "documents").select(F.explode(F.array(F.lit("concepts"), F.lit("entities"))).alias("kind_dir"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), front.alias("front"), F.col("text").alias("body"))
    left, _, _ = jobs.apply_lint(d, _copies_decided(spark, sf_dir), _now())
    return left.select("kind_dir", "slug", page_source.front_value("front", "updated").alias("updated"), F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"""WITH {_COPIES}
SELECT c.doc_id AS ord, CASE WHEN nth = 1 THEN 'merge' ELSE 'keep' END AS verdict, nth = 1 AS applied, CASE WHEN nth = 1 THEN 'copies' ELSE 'skipped — one of the pages was merged away earlier in this run' END AS reason
FROM c WHERE b IS NOT NULL AND nth <= 2 UNION ALL
SELECT doc_id, 'merge', FALSE, 'copies' FROM c WHERE b IS NOT NULL AND nth > 2""")
def lint_report(spark, sf_dir):
    decided = _copies_decided(spark, sf_dir)
    return near_pages.lint_report(decided, near_pages.killset_fold(decided)).select("ord", "verdict", "applied", "reason")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' ELSE 'rewritten' END AS outcome, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '2024-02-01' END AS updated,
  md5(CASE WHEN doc_id % 4 = 0 THEN text ELSE 'better ' || doc_id END) AS block FROM documents""")
def rewrite_fenced(spark, sf_dir):
    """Responses in code fences, one in four of them a SKIP."""
    said = F.when(F.col("doc_id") % 4 == 0, "```\nSKIP\n```").otherwise(F.concat(F.lit("```markdown\n\nbetter "), F.col("doc_id").cast("string"), F.lit("\n```\n")))
    d = _t(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.lit('[["title", "t"]]').alias("front"), FMT.block(F.lit("b0"), F.lit("x")).alias("block"), "text", said.alias("response"))
    got = pages.rewrite(rows.withColumn("body", F.concat(F.lit("# t\n\n"), F.replace("block", F.lit("\nx\n"), F.concat(F.lit("\n"), "text", F.lit("\n"))))).drop("block", "text"), _now())
    body = F.regexp_replace(F.regexp_extract("body", r"(?s)id=\w+ -->\n(.*)\n<!-- engine:end", 1), "", "")
    return got.select("doc_id", "outcome", page_source.front_value("front", "updated").alias("updated"), F.md5(body.cast("binary")).alias("block"))


@query(f"""WITH {_PAGES}, i AS (SELECT *, {_FACT_ID.format(slug="title", summary="'consolidated@2024-02-01'")} AS fid, strpos(body, '<!-- engine:fact') AS s FROM pages0)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN body ELSE left(body, s - 1) || '<!-- engine:fact id=' || fid || ' -->' || chr(10) || 'all in one' || chr(10) || '<!-- engine:end -->' || chr(10) || 'footer' || chr(10) END) AS body FROM i""")
def consolidate_splice(spark, sf_dir):
    got = pages.consolidate(docs_as_pages(spark, sf_dir).withColumn("consolidated", F.lit("all in one\n")), _now())
    return got.select("doc_id", F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"""WITH {_PAGES}, i AS (SELECT *, {_FACT_ID.format(slug="slug", summary="'rewritten@2024-02-01'")} AS fid, strpos(body, '<!-- engine:fact') AS s FROM pages0)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' ELSE 'rewritten' END AS outcome, md5(CASE WHEN doc_id % 4 = 0 THEN body ELSE left(body, s - 1) || '<!-- engine:fact id=' || fid || ' -->' || chr(10) || 'better' || chr(10) || '<!-- engine:end -->'
  || substr(substr(body, s), strpos(substr(body, s), '<!-- engine:end -->') + 19) END) AS body FROM i""")
def rewrite_splice(spark, sf_dir):
    rows = docs_as_pages(spark, sf_dir).withColumn("response", F.when(F.col("doc_id") % 4 == 0, "SKIP").otherwise(" better "))
    return pages.rewrite(rows, _now()).select("doc_id", "outcome", F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang=' || lang || ';n=' || n_chars ELSE 'lang=' || lang END AS kept FROM documents")
def owned_key_strip(spark, sf_dir):
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    entries = F.array(entry("title", F.col("source")), entry("lang", F.col("lang")), entry("tags", F.lit("x")), F.when(F.col("doc_id") % 2 == 0, entry("n", F.col("n_chars"))).otherwise(entry("created", F.lit("y"))))
    kept = sets.strip_keys(entries, page_source.OWNED_KEYS)
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(kept, lambda e: F.concat(e.k, F.lit("="), e.v)), ";").alias("kept"))


_FORM = "trim(regexp_replace(lower({0}), '[-_\\s]+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'entities' ELSE 'concepts' END AS kind_dir, lower(s_name) AS slug, md5(CAST(s_suppkey AS VARCHAR)) AS title FROM supplier),
t AS (SELECT kind_dir, slug, title FROM f WHERE s_suppkey % 3 = 0),
s AS (SELECT f.s_suppkey, t.slug, greatest(1 - CAST(levenshtein({_FORM.format("f.slug")}, {_FORM.format("t.slug")}) AS DOUBLE) / greatest(length({_FORM.format("f.slug")}), length({_FORM.format("t.slug")})),
  1 - CAST(levenshtein({_FORM.format("f.title")}, {_FORM.format("t.title")}) AS DOUBLE) / greatest(length({_FORM.format("f.title")}), length({_FORM.format("t.title")}))) AS score FROM f JOIN t ON f.kind_dir = t.kind_dir AND f.slug <> t.slug),
b AS (SELECT s_suppkey, arg_min(slug, (-score, slug)) AS slug FROM s WHERE score >= 0.75 GROUP BY 1)
SELECT f.s_suppkey, 'wiki/' || f.kind_dir || '/' || CASE WHEN e.slug IS NOT NULL THEN f.slug ELSE coalesce(b.slug, f.slug) END || '.md' AS target_path, e.slug IS NULL AND b.slug IS NULL AS is_new
FROM f LEFT JOIN t e ON e.kind_dir = f.kind_dir AND e.slug = f.slug LEFT JOIN b ON b.s_suppkey = f.s_suppkey""")
def decide(spark, sf_dir):
    """Suppliers as facts, every third of them a page already."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "entity").otherwise("concept").alias("kind"), F.lower("s_name").alias("page_slug"), F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("page_title"))
    known = s.where(F.col("s_suppkey") % 3 == 0).select(page_source.kind_dir(F.col("kind")).alias("kind_dir"), F.col("page_slug").alias("slug"), F.col("page_title").alias("title"))
    got = pages.decide(s.withColumns({"session_id": F.lit("s"), "fact_ord": F.col("s_suppkey").cast("int")}), known)
    return got.select("s_suppkey", "target_path", "is_new")


def _supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    s = _t(spark, sf_dir, "supplier")
    return s.select(
        F.lit("s").alias("session_id"), F.col("s_suppkey").cast("int").alias("fact_ord"), F.lit("concept").alias("kind"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("page_slug"),
        F.md5(F.col("s_nationkey").cast("string").cast("binary")).alias("page_title"), F.col("s_name").alias("summary"), F.concat(F.lit(" by "), "s_name").alias("body_markdown"),
        F.struct(F.array("s_name").alias("uses"), none.alias("used_by"), none.alias("related"), none.alias("supersedes")).alias("relations"), F.lit(1.0).cast("float").alias("confidence"),
    )


@query(f"""WITH f AS (SELECT s_suppkey, 'n' || s_nationkey AS slug, md5(CAST(s_nationkey AS VARCHAR)) AS title, {_FACT_ID.format(slug="('n' || s_nationkey)", summary="lower(s_name)")} AS fid, s_name FROM supplier)
SELECT slug, md5('# ' || any_value(title) || chr(10) || chr(10) || string_agg('<!-- engine:fact id=' || fid || ' -->' || chr(10) || 'by ' || s_name || chr(10) || '<!-- engine:end -->', chr(10) || chr(10) ORDER BY s_suppkey) || chr(10)) AS body FROM f GROUP BY slug""")
def fold_facts(spark, sf_dir):
    """Suppliers as facts on their nations' pages, all of them new."""
    facts = _supplier_facts(spark, sf_dir).withColumns({"kind_dir": F.lit("concepts"), "target_slug": F.col("page_slug"), "source": F.lit("[[s]]")})
    folded = pages.fold_facts(facts, spark.createDataFrame([], pages.PAGE_SCHEMA), "2024-02-01")
    return folded.select("slug", F.md5(F.col("body").cast("binary")).alias("body"))


# ---- runs, times, requests ------------------------------------------------------------------------------------------


@query("""
SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS session_id, event_type AS error FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) WHERE event_type <> 'view'""")
def tail_n(spark, sf_dir):
    """The last 20 lines of a run log; lines of views are malformed, so fewer records come out."""
    e = _t(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"), F.array().cast("array<string>").alias("touched_pages"), F.col("event_type").alias("error")))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "view", F.lit("{oops")).otherwise(good).alias("raw"))
    return runs.last_runs(lines, 20).select("line_no", "session_id", "error")


@query(f"""
WITH s AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '{NOW}') - epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 0 THEN 'future' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hr ago' WHEN s < 172800 THEN '1 day ago'
  WHEN s < 2592000 THEN (s // 86400) || ' days ago' ELSE (s // 86400 // 30) || ' mo ago' END AS ago FROM s""")
def relative_time(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", times.relative_time(F.col("ts").cast("timestamp"), _now()).alias("ago"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN ts - INTERVAL 2 HOUR END AS ts FROM events")
def rfc3339_parse(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.concat(stamp, F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise(""))
    return _t(spark, sf_dir, "events").select("event_id", times.parse_rfc3339(raw).cast("timestamp_ntz").alias("ts"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS session_id, 0 AS fact_ord, 'concept' AS kind, source AS page_slug, md5(text) AS body, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 1 END AS FLOAT) AS confidence, doc_id % 2 = 0 AS low_confidence, lang AS uses
FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0""")
def response_parse(spark, sf_dir):
    """Responses in fences, in prose, broken (one in eleven), or with facts of an unknown kind (one in five)."""
    d = _t(spark, sf_dir, "documents")
    fact = F.struct(F.when(F.col("doc_id") % 5 == 0, "rumour").otherwise("concept").alias("type"), F.col("source").alias("page_slug"), F.col("source").alias("page_title"), F.lit("s").alias("summary"), F.col("text").alias("body_markdown"), F.struct(F.array("lang").alias("uses")).alias("relations"), F.when(F.col("doc_id") % 2 == 0, 0.25).alias("confidence"))
    whole = F.to_json(F.struct(F.lit("t").alias("title"), F.array(fact).alias("extracted")))
    said = F.when(F.col("doc_id") % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Here it is: "), whole)).otherwise(whole)
    facts = requests.parse_responses(d.select(F.col("doc_id").cast("string").alias("session_id"), said.alias("text")))[1]
    return facts.select("session_id", "fact_ord", "kind", "page_slug", F.md5(F.col("body_markdown").cast("binary")).alias("body"), "confidence", "low_confidence", F.array_join("relations.uses", ",").alias("uses"))


@query("""
WITH m AS (SELECT conv_id, string_agg('[' || role || '] ' || text || chr(10), chr(10) ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id),
k AS (SELECT 'Concepts:' || chr(10) || string_agg('- `' || lower(n_name) || '` — ' || n_name || ': ' || n_regionkey || chr(10), '' ORDER BY lower(n_name)) AS topics FROM nation)
SELECT CAST(conv_id AS VARCHAR) AS session_id, md5('Known: 25' || chr(10) || topics || 'Session:' || chr(10) || t) AS user FROM m, k""")
def request_render(spark, sf_dir):
    messages, calls = sessions.reconstruct(turns_as_events(spark, sf_dir))
    known = _t(spark, sf_dir, "nation").select(F.lit("concepts").alias("kind_dir"), F.lower("n_name").alias("slug"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("summary"))
    template = "Known: {{ existing_topics_count }}\n{{ existing_topics }}Session:\n{{ transcript }}"
    made = requests.build_requests(requests.render_transcripts(messages, calls), known, "system", template, "any", 4096)
    return made.select("session_id", F.md5(F.col("user").cast("binary")).alias("user"))


@query("""
WITH m AS (SELECT conv_id, count(*) AS n, string_agg(chr(10) || '[' || role || '] ' || text, '' ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' AND strlen(text) <= 8192 GROUP BY conv_id),
w AS (SELECT conv_id, arg_min('/work/' || conv_id, turn) FILTER (role = 'user') AS cwd FROM conversations GROUP BY conv_id)
SELECT CAST(m.conv_id AS VARCHAR) AS session_id, md5('at most 5 facts' || chr(10) || 'no topics' || chr(10) || 'cwd ' || cwd || chr(10) || n || ' messages:' || t || chr(10)) AS user FROM m JOIN w USING (conv_id)""")
def template_render(spark, sf_dir):
    """A template with conditions, a loop, dotted names and a filter over all sessions."""
    events = turns_as_events(spark, sf_dir).where(F.octet_length(F.coalesce(F.try_variant_get("content", "$[0].text", "string"), F.lit(""))) <= 8192)
    merged = sessions.merge_snapshots(events)
    known = requests.session_values(sessions.session_metadata(turns_as_events(spark, sf_dir)), *sessions.reconstruct(merged))
    template = (
        "{% if max_facts %}at most {{ max_facts }} facts{% endif %}\n{% if existing_topics_count == 0 %}no topics{% else %}{{ existing_topics }}{% endif %}\n"
        "{% if transcript.metadata.cwd %}cwd {{ transcript.metadata.cwd }}{% endif %}\n{{ transcript.messages | length }} messages:"
        "{% for m in transcript.messages %}\n[{{ m.role }}] {{ m.content }}{% if m.tool_calls %} called{% for c in m.tool_calls %} {{ c.name }}{% endfor %}{% endif %}{% endfor %}\n\n"
    )
    none = spark.createDataFrame([], "kind_dir string, slug string, title string, summary string")
    made = requests.build_requests(known, none, "system", template, "any", 4096, max_facts=5)
    return made.select("session_id", F.md5(F.col("user").cast("binary")).alias("user"))


from lodestrand import catalog_jobs  # noqa: E402, F401  it adds its queries to the tables above
