import json
import random
import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import sets, text, times
from lodestrand.operators import near_pages, pages, requests, sessions
from lodestrand.plans import jobs
from lodestrand.sources import runs, sinks, transcripts


def value(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("s", ["", "abc", "é" * 9, "a€b€c", "🙂🙂"])
@pytest.mark.parametrize("cap", [0, 1, 2, 3, 4, 5, 7, 100])
def test_truncate_bytes(spark, s, cap):
    raw = s.encode()
    n = min(cap, len(raw))
    while n and n < len(raw) and raw[n] & 0xC0 == 0x80:
        n -= 1
    want = s if len(raw) <= cap else raw[:n].decode() + f"\n[... truncated, original was {len(raw)} bytes]"
    assert value(spark, text.truncate_bytes("s", cap), s=s) == want


def test_normal_forms(spark):
    assert value(spark, text.normalize("s"), s=" Foo__Bar-　 ΣΑΣ ") == "foo bar σασ"
    assert value(spark, text.collapse_whitespace("s"), s="a 　 b\n") == "a b"
    assert value(spark, text.fact_id("a", "b"), a="a", b="Hello   World") == "e79dae4a"
    assert value(spark, text.similarity("a", "b"), a="", b="") == 1.0
    assert sorted(value(spark, text.bigram_set("s"), s="A b")) == ["ab"] and value(spark, text.bigram_set("s"), s="x") == []


def test_three_way_merge(spark):
    got = value(spark, sets.three_way_merge("s", "c", "a"), s=["a", "b"], c=["a", "x"], a=["b", "c"])
    assert got == ["c", "x"] == pages.three_way(["a", "b"], ["a", "x"], ["b", "c"])


def test_blocks(spark):
    f = text.PageFormat("m")
    page = "intro\n<!-- m:fact id=1 -->\nold\n<!-- m:end -->\ntail\n<!-- m:fact id=2 -->\nopen"
    assert [tuple(b) for b in value(spark, f.blocks("s"), s=page)] == [("1", "old")]
    assert value(spark, f.upsert("s", F.lit("1"), F.lit("new")), s=page) == page.replace("old", "new")
    assert value(spark, f.upsert("s", F.lit("9"), F.lit("new")), s="x\n\n") == "x\n\n<!-- m:fact id=9 -->\nnew\n<!-- m:end -->\n"
    assert value(spark, text.insert_under_heading(F.col("s"), F.lit("## d"), F.lit("- e")), s="## d\n\n- a\n\n## z\n") == "## d\n\n- a\n- e\n\n## z\n"
    assert value(spark, f.replace_region("s", F.lit("in")), s="x").startswith("x\n\n" + f.region[0] + "in" + f.region[1])


def test_times(spark):
    now = datetime(2026, 5, 10, 12, tzinfo=UTC)
    assert times.parse_since("7d", now).day == 3 and times.parse_since("-7d", now).day == 17 and times.parse_since("2026-04-01", now).month == 4
    for bad in ("7", "5x", ""):
        with pytest.raises(ValueError):
            times.parse_since(bad, now)
    assert value(spark, times.parse_rfc3339("s").isNull(), s="2026-05-10T10:00:00") and value(spark, times.parse_rfc3339("s").cast("string"), s="2026-05-10T10:00:00+02:00") == "2026-05-10 08:00:00"


LINES = [
    '{"type":"user","sessionId":"s","uuid":"u1","timestamp":"2026-05-10T10:00:00Z","cwd":"/w","message":{"role":"user","content":"hi"},"extra":1}',
    '{"type":"assistant","sessionId":"s","uuid":"a1","timestamp":"2026-05-10T10:00:01Z","message":{"role":"assistant","model":"m","usage":{"input_tokens":3,"output_tokens":"x"},"content":[{"type":"text","text":"yo"},{"type":"tool_use","id":"t","name":"Read","input":{"b":1,"a":2}}]}}',
    '{"type":"user","sessionId":"s","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":[{"type":"text","text":"one"},{"k":1}]}]}}',
    '{"type":"assistant","sessionId":"s","message":{"role":"assistant","model":"<synthetic>","content":[{"type":"text","text":"lost"},{"type":"what"}]}}',
    '{"type":"user","sessionId":"s","isSidechain":true,"message":{"role":"user","content":"side"}}',
    "", "not json", "[1]", '{"type":"nope","sessionId":"s"}', '{"type":"user","sessionId":1,"message":{"role":"user","content":"x"}}', '{"type":"user","sessionId":"s","isSidechain":null,"message":{"role":"user","content":"x"}}',
]


def test_transcripts(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(LINES))
    events, rejects = transcripts.scan_transcript(spark, str(tmp_path / "s.jsonl"))
    assert events.count() == 5 and {r["line_no"]: r["reason"] for r in rejects.collect()} == {7: "not JSON", 8: "not an object", 9: "unknown type", 10: "missing or ill-typed field", 11: "missing or ill-typed field"}
    messages, calls = sessions.reconstruct(events)
    assert [(m["role"], m["content"]) for m in messages.orderBy("line_no").collect()] == [("user", "hi"), ("assistant", "yo")]
    assert [tuple(c[k] for k in ("tool_use_id", "name", "input", "output")) for c in calls.collect()] == [("t", "Read", '{"a":2,"b":1}', 'one\n{"k":1}')]
    meta = sessions.session_metadata(events).first()
    assert (meta["cwd"], meta["model"], meta["input_tokens"], meta["output_tokens"], meta["event_count"]) == ("/w", "m", 3, 0, 5)
    assert transcripts.list_sessions(spark, str(tmp_path)).first()["session_id"] == "s"


def test_blocked_pairs_equal_nested_loop(spark):
    names = [("entities", "spark-sql", "Spark SQL", "fast table engine for queries"), ("entities", "spark-sq", "Spark SQ", "another thing"), ("concepts", "cache", "缓存", "原子写 文件 缓存"), ("concepts", "atomic", "x", "原子 文件"), ("concepts", "a", "", ""), ("concepts", "b", "", ""), ("concepts", "table", "Engine", "table engine for fast queries")]
    topics = spark.createDataFrame(names, "kind_dir string, slug string, title string, summary string")
    a, b = (sorted(map(tuple, f(topics).collect())) for f in (near_pages.near_pairs, near_pages.near_pairs_blocked))
    assert a == b and len(a) >= 4


def test_killset_is_ordered(spark):
    d = spark.createDataFrame(
        [(1, "c", "a", "c", "b", "merge", "a"), (2, "c", "b", "c", "c", "merge", "c"), (3, "c", "a", "c", "c", "merge", "c"), (4, "c", "x", "c", "y", "keep", None), (5, "c", "p", "e", "p", "merge", "p"), (6, "c", "q", "c", "r", "merge", "other"), (7, "e", "b", "c", "z", "merge", "z")],
        "ord int, kind_a string, slug_a string, kind_b string, slug_b string, verdict string, winner string",
    )
    merges = near_pages.killset_fold(d)
    assert sorted(map(tuple, merges.collect())) == [(1, "c", "a", "c", "b"), (3, "c", "c", "c", "a"), (5, "c", "p", "e", "p"), (7, "c", "z", "e", "b")]
    report = {r["ord"]: (r["verdict"], r["applied"]) for r in near_pages.lint_report(d.withColumn("reason", F.lit("r")), merges).collect()}
    assert report == {1: ("merge", True), 2: ("keep", False), 3: ("merge", True), 4: ("keep", False), 5: ("merge", True), 6: ("merge", False), 7: ("merge", True)}


def test_merges_know_pages_by_kind_and_slug(spark):
    page = lambda kind, slug: (kind, slug, '[["title", "T ' + slug + '"], ["updated", "2020-01-01"], ["tags", ["a"]]]', "old")
    old = spark.createDataFrame([page("concepts", "foo"), page("entities", "foo"), page("concepts", "bar")], "kind_dir string, slug string, front string, body string")
    said = spark.createDataFrame([("concepts", "foo", "concepts", "bar", '{"decision":"merge","winning_slug":"bar","merged_body":" both ","reason":"same"}')], "kind_a string, slug_a string, kind_b string, slug_b string, text string")
    decisions = requests.parse_verdicts(said.withColumn("ord", F.lit(1)))
    left, log, _ = jobs.apply_lint(old, decisions, F.to_timestamp(F.lit("2026-05-10 01:02:03")))
    got = {(r["kind_dir"], r["slug"]): r for r in left.collect()}
    assert set(got) == {("entities", "foo"), ("concepts", "bar")} and got["entities", "foo"]["body"] == "old"
    won = got["concepts", "bar"]
    assert won["body"].startswith("# T bar\n\n<!-- engine:fact id=") and won["body"].endswith(" -->\nboth\n<!-- engine:end -->\n") and json.loads(won["front"]) == [["title", "T bar"], ["updated", "2026-05-10"], ["tags", ["a"]]]
    assert log.first()["entry"] == "\n## [2026-05-10] lint | merged `foo` → `bar`\n  Reason: same\n"


def _facts(spark, rows):
    none = {"uses": [], "used_by": [], "related": [], "supersedes": []}
    return spark.createDataFrame([(s, n, kind, slug, title, f"sum {s} {n}", f"body {n}", none, 1.0) for s, n, kind, slug, title in rows], pages.FACT_SCHEMA)


TOPICS = "kind_dir string, slug string, title string, summary string"


def test_fold_is_sequential(spark):
    fact = lambda n, slug, rel: ("s", n, "concept", slug, "Atomic write", f"sum {n}", f"body {n}", {"uses": rel, "used_by": [], "related": [], "supersedes": []}, 1.0)
    facts = spark.createDataFrame([fact(0, "atomic-write", ["x"]), fact(1, "atomic-writes", ["y"])], pages.FACT_SCHEMA)
    placed = pages.resolve(facts, spark.createDataFrame([], TOPICS))
    assert [(r["target_slug"], r["is_new"]) for r in placed.orderBy("fact_ord").collect()] == [("atomic-write", True), ("atomic-write", False)]
    page = pages.fold_facts(placed.withColumn("source", F.lit("[[s]]")), spark.createDataFrame([], pages.PAGE_SCHEMA), "2026-05-10").first()
    assert page["body"].count("engine:fact") == 2 and '["y"]' in page["front"] and "2026-05-10" in page["front"]


def test_resolution_sees_pages_and_titles_of_the_run(spark):
    """An exact page made before wins over an old page with a like title; a fact renames the page it is applied to; kinds are apart."""
    topics = spark.createDataFrame([("concepts", "old-page", "Shared title of pages", ""), ("concepts", "other", "Nothing like it at all", "")], TOPICS)
    facts = _facts(spark, [("a", 0, "concept", "brand-new", "Quite another thing"), ("a", 1, "concept", "brand-new", "Shared title of page"), ("b", 0, "gotcha", "zzzz", "Shared title of pages!"), ("b", 1, "entity", "old-page", "Shared title of pages"), ("c", 0, "concept", "other", "Renamed to something long"), ("c", 1, "concept", "qqqq", "Renamed to something longer")])
    got = {(r["session_id"], r["fact_ord"]): (r["kind_dir"], r["target_slug"], r["is_new"]) for r in pages.resolve(facts, topics).collect()}
    assert got["a", 0] == ("concepts", "brand-new", True) and got["a", 1] == ("concepts", "brand-new", False)
    assert got["b", 0] == ("concepts", "old-page", False) and got["b", 1] == ("entities", "old-page", True)
    assert got["c", 0] == ("concepts", "other", False) and got["c", 1] == ("concepts", "other", False)


def test_resolution_equals_brute_force(spark):
    r = random.Random(3)
    words = ["cache", "index", "write", "atomic", "page"]
    slug = lambda: "-".join(r.sample(words, 2)) + r.choice(["", "s", "-1", "-2"])
    known = {("concepts", s): s.title() for s in {slug() for _ in range(12)}}
    rows = [(f"s{n // 5}", n % 5, r.choice(["concept", "entity"]), slug(), slug().title()) for n in range(60)]
    got = {(x["session_id"], x["fact_ord"]): (x["target_slug"], x["is_new"]) for x in pages.resolve(_facts(spark, rows), spark.createDataFrame([(*k, t, "") for k, t in known.items()], TOPICS)).collect()}
    want = {}
    for kind, folder in (("concept", "concepts"), ("entity", "entities")):
        mine = sorted(x for x in rows if x[2] == kind)
        out = pages.resolve_in_order([{"page_slug": x[3], "page_title": x[4]} for x in mine], [(s, t) for (f, s), t in known.items() if f == folder])
        want |= {x[:2]: o for x, o in zip(mine, out, strict=True)}
    assert got == want and sum(n for _, n in want.values()) > 5


def test_alike_equals_brute_force(spark):
    r = random.Random(2)
    strings = {"", "a", "ab"}
    for _ in range(40):
        word = "".join(r.choice("abcde-") for _ in range(r.randint(1, 14)))
        strings |= {word, word[1:] + "q", word[: len(word) // 2] + "x" + word[len(word) // 2 :]}
    strings = sorted(strings)
    rows = spark.createDataFrame([(i % 2, s, i % 3 > 0) for i, s in enumerate(strings)], "g int, s string, asks boolean")
    from lodestrand.operators.alike import alike

    for num, den in ((3, 4), (13, 20)):
        pairs = spark.createDataFrame([(a, b) for i, a in enumerate(strings) for j, b in enumerate(strings) if i % 3 > 0 and i % 2 == j % 2], "x string, y string")
        want = {(p["x"], p["y"]) for p in pairs.where(text.similarity("x", "y") >= num / den - 1e-12).collect()}
        assert sorted((p["x"], p["y"]) for p in alike(rows, num, den).collect()) == sorted(want)


BASE = """
[meta]
name = "default"
model = "m1"

[byte_caps]
tool_use = 10
tool_result = 8192
user_message = 8192
assistant_message = 16384

[prompt]
system = "BASE"
user_template = '''
{% if existing_topics_count == 0 %}fresh{% else %}{{ existing_topics }}{% endif %}
{% if max_facts %}max {{ max_facts }}{% endif %}{% if vault_language %} {{ vault_language }}{% endif %}
{% for m in transcript.messages %}[{{ m.role }}] {{ m.content }}
{% if m.tool_calls %}{% for tc in m.tool_calls %}- {{ tc.name }}: {{ tc.input }}{% if tc.output %} = {{ tc.output }}{% endif %}
{% endfor %}{% endif %}{% endfor %}'''
"""
RECIPE = '[meta]\nname = "short"\ninherits = "default"\n[overrides]\nmax_facts_per_session = 5\n[prompt_overrides]\nextra_system = "\\n\\nSHORT"\n'


def _event(kind, n, **more):
    message = {k: more.pop(k) for k in ("role", "content", "model", "usage") if k in more}
    return json.dumps({"type": kind, "sessionId": "s-1", "uuid": f"u{n}", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": message, **more})


def _events(spark):
    lines = [
        _event("user", 1, role="user", content="hello", cwd="/w"),
        _event("assistant", 2, role="assistant", content=[{"type": "text", "text": "yes"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "long enough to cut"}}], model="m", usage={"input_tokens": 3, "output_tokens": 4}),
        _event("user", 3, role="user", content=[{"type": "tool_result", "tool_use_id": "t1", "content": "found"}]),
    ]
    return transcripts.parse_events(spark.createDataFrame([(n, x) for n, x in enumerate(lines, 1)], "line_no int, raw string"))[0]


def test_templates_and_recipes(spark, tmp_path):
    (tmp_path / "recipes").mkdir()
    (tmp_path / "distill.toml").write_text(BASE)
    (tmp_path / "recipes/short.toml").write_text(RECIPE)
    plain, short = runs.Template.load(str(tmp_path)), runs.Template.load(str(tmp_path), "short")
    assert (plain.model, plain.max_tokens, plain.max_facts, plain.system) == ("m1", 4096, None, "BASE") and (short.max_facts, short.model, short.system) == (5, "m1", "BASE\n\nSHORT")
    none = spark.createDataFrame([], TOPICS)
    user = jobs.prepare(_events(spark), none, short, vault_language="en").requests.first()["user"]
    assert user == 'fresh\nmax 5 en\n[user] hello\n[assistant] yes\n- read: {"path":"l\n[... truncated, original was 29 bytes] = found\n'
    with pytest.raises(ValueError):
        requests.TextTemplate("{% if x %}")


def test_whole_jobs(spark):
    template, none = runs.Template.parse(BASE), spark.createDataFrame([], TOPICS)
    now = F.to_timestamp(F.lit("2026-05-10 10:30:00"))
    said = json.dumps({"title": "A session", "tags": [], "extracted": [{"type": "concept", "page_slug": "cache", "page_title": "Cache", "summary": "s", "body_markdown": "b"}]})
    prepared = jobs.prepare(_events(spark), none, template)
    answer = lambda text: prepared.requests.select("request_id", F.lit(text).alias("text"))
    old = spark.createDataFrame([("concepts", "kept", '[["title", "Kept"]]', "k")], pages.PAGE_SCHEMA)
    out = jobs.ingest(prepared, answer(said), none, old, now, "2026-05-10", transcripts=spark.createDataFrame([("s-1", "{}")], "session_id string, raw string"))
    written = {r["slug"]: r for r in out.pages.collect()}
    assert set(written) == {"kept", "cache"} and "[[../raw/sessions/2026-05-10T10-30_s-1]]" in written["cache"]["front"]
    head = "---\ntitle: A session\ntype: source\ncreated: 2026-05-10\ntags: []\n---\n\n# A session\n\nRaw session transcript (JSONL).\n\n"
    assert tuple(out.raw.first()) == ("2026-05-10T10-30_s-1.md", head + "```jsonl\n{}\n```\n") and "[[concepts/cache]] · Cache" in out.index.first()["text"] and out.index.first()["text"].startswith("# Index\n")
    record = out.records.first()
    assert record["touched_pages"] == ["wiki/concepts/cache.md"] and record["error"] is None and record["input_tokens"] == 3
    assert out.log.first()["touched"] == ["concepts/cache"] and out.log.first()["title"] == "A session"
    failed = jobs.ingest(prepared, answer("no object here"), none, old, now, "2026-05-10")
    assert failed.records.first()["error"] == "no JSON object" and [r["slug"] for r in failed.pages.collect()] == ["kept"] and failed.raw.count() == 0
    listing = spark.createDataFrame([("s-1", "p"), ("s-2", "q")], "session_id string, path string")
    assert [(r["n"], r["of"]) for r in jobs.progress(listing).orderBy("n").collect()] == [(1, 2), (2, 2)]
    assert jobs.replay(prepared, answer(said), listing, none, old, now, "2026-05-10").pages.count() == 2
    outputs, facts, _ = jobs.dry_run(_events(spark), template, answer(said))
    assert outputs.count() == facts.count() == 1 and jobs.stages(prepared, answer(said))["tool_calls"].count() == 1
    left, log = jobs.audit(old, spark.createDataFrame([("concepts", "kept", '{"verdict":"delete","reason":"r"}')], "kind_dir string, slug string, text string"), now)
    assert left.isEmpty() and "audit | delete kept" in log.first()["entry"]
    pairs, decisions = jobs.lint(spark.createDataFrame([("concepts", "page-one", "Page one", "x"), ("concepts", "page-ones", "Page ones", "y")], TOPICS), spark.createDataFrame([], "kind_a string, slug_a string, kind_b string, slug_b string, text string"))
    assert pairs.count() == 1 and decisions.first()["verdict"] == "keep" and jobs.apply_lint(old, decisions, now)[0].count() == 1


def test_fences(spark):
    rows = spark.createDataFrame([("a", '[["title", "A"]]', "x <!-- engine:fact id=1 -->\nold\n<!-- engine:end --> y", said) for said in ("```markdown\n\nnew\n```", "```\nSKIP\n```", "plain")], "slug string, front string, body string, response string")
    now = F.to_timestamp(F.lit("2026-05-10 10:30:00"))
    got = pages.rewrite(rows, now).collect()
    assert [g["outcome"] for g in got] == ["rewritten", "skipped", "rewritten"] and "-->\nnew\n<!--" in got[0]["body"] and "-->\nplain\n<!--" in got[2]["body"]
    assert json.loads(got[0]["front"]) == [["title", "A"], ["updated", "2026-05-10"]] and json.loads(got[1]["front"]) == [["title", "A"]]
    two = rows.limit(1).select(F.lit("T").alias("title"), F.concat("body", "body").alias("body"), F.col("response").alias("consolidated"))
    assert pages.consolidate(two, now).first()["body"].count("-->\nnew\n<!--") == 1


def test_racing_writers(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "raced"))
    first = table.commit(spark.range(1), None)
    gate, won, lost = threading.Barrier(4), [], []
    claim = sinks.VersionedTable._claim

    class Held(sinks.VersionedTable):
        def _claim(self, *at):
            gate.wait(60)  # all have written and none has claimed the number
            return claim(self, *at)

    def write(n):
        try:
            won.append((Held(spark, table.root).commit(spark.range(10 + n), first), n))
        except RuntimeError:
            lost.append(n)

    writers = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and len(lost) == 3 and table.read().count() == 10 + won[0][1] and table.current() == won[0][0]


def test_lines_of_split_files(spark, tmp_path):
    texts = {"0001.jsonl": [f"a{i}" for i in range(500)], "0002.jsonl": ["b0", "", "b2"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = transcripts.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in texts.items():
        mine = sorted((g["line_no"], g["raw"]) for g in got if g["path"].endswith(name))
        assert mine == list(enumerate(lines, 1))
    final = tmp_path / "final.txt"
    final.write_text(json.dumps({"type": "last-prompt", "sessionId": "s", "lastPrompt": "p"}) + "\n")
    events, rejects = transcripts.scan_snapshots(spark, str(tmp_path), str(final))
    assert [(e["source_rank"], e["line_no"]) for e in events.collect()] == [(1 << 30, 1)] and {(x["source_rank"], x["reason"]) for x in rejects.collect()} == {(1, "not JSON"), (2, "not JSON")}


def test_listing(spark, tmp_path):
    import os
    from datetime import datetime, timezone

    for n, name in enumerate(("b", "a")):
        (tmp_path / f"p{n}").mkdir()
        (tmp_path / f"p{n}/{name}.jsonl").write_text("x")
        os.utime(tmp_path / f"p{n}/{name}.jsonl", (1_700_000_000 + n * 1000,) * 2)
    every = transcripts.list_sessions(spark, str(tmp_path))
    assert [r["session_id"] for r in every.collect()] == ["a", "b"] and transcripts.find_session(every, "b").first()["path"].endswith("b.jsonl") and transcripts.most_recent(every).first()["session_id"] == "a"
    since = datetime.fromtimestamp(1_700_001_000, timezone.utc)
    assert [r["session_id"] for r in transcripts.list_sessions(spark, str(tmp_path), since).collect()] == ["a"]


def test_responses(spark):
    good = '```json\n{"title":"t","tags":["a",1],"extracted":[{"type":"concept","page_slug":"p","page_title":"P","summary":"s","body_markdown":"b","relations":{"used-by":["q"]},"confidence":0.2},{"type":"what"}]}\n```'
    outputs, facts, errors = requests.parse_responses(spark.createDataFrame([("1", good), ("2", "nothing"), ("3", '{"extracted":[]}')], "session_id string, text string"))
    assert outputs.first()["tags"] == ["a"] and facts.count() == 1 and facts.first()["low_confidence"] and facts.first()["relations"]["used_by"] == ["q"]
    assert {r["session_id"]: r["error"] for r in errors.collect()} == {"2": "no JSON object", "3": "no title"}


def test_runs_and_sinks(spark, tmp_path):
    record = '{"session_id":"abcdefghij","started_at":"2026-05-10T10:00:00Z","finished_at":"2026-05-10T10:00:00Z","touched_pages":["p"],"input_tokens":1,"output_tokens":2}'
    lines = spark.createDataFrame([(1, record), (2, record), (3, "{oops")], "line_no int, raw string")
    assert runs.last_runs(lines, 2).count() == 1
    shown = sinks.status_rows(runs.last_runs(lines, 3), F.to_timestamp(F.lit("2026-05-10 10:05:00"))).first()
    assert (shown["when"], shown["session"], shown["tokens"]) == ("5 min ago", "abcdefgh", "tokens: 1 in / 2 out")
    sinks.write_atomic(tmp_path / "a/b.md", "x")
    assert (tmp_path / "a/b.md").read_text() == "x"
    names = spark.createDataFrame([("0007.jsonl",), ("x.jsonl",), ("9.txt",)], "name string")
    assert sinks.next_snapshot(names).first()["name"] == "0008.jsonl"
    t = sinks.VersionedTable(spark, str(tmp_path / "v"))
    first = t.commit(spark.range(3), None)
    t.commit(spark.range(4), first)
    with pytest.raises(RuntimeError):
        t.commit(spark.range(5), first)
    assert t.read().count() == 4
    assert runs.Config.parse(runs.Config("/v", skip_paths=("/a",)).dump()).skip_paths == ("/a",)


def test_best_alike_equals_brute_force_and_leaves_few_to_tiles(spark, monkeypatch):
    from lodestrand.operators import alike as module

    r = random.Random(3)
    names = [f"supplier {i:06d}" for i in r.sample(range(3000), 400)] + ["", "a", "ab", "abc", "abcd", "abce", "x" * 70, "x" * 69 + "y", "x" * 90]
    known = [("e", n, f"s{i % 390:03d}") for i, n in enumerate(names) if i % 3 == 0] + [("e", names[0], "other"), ("c", "abcd", "s1")]
    asks = [("e", n, f"s{i % 390:03d}" if i % 2 else None) for i, n in enumerate(names)] + [("c", "abcd", "s1"), ("e", None, None)]
    left = []
    monkeypatch.setattr(module, "alike", lambda forms, *t, f=module.alike: left.append(forms.where("asks").count()) or f(forms, *t))
    got = module.best_alike(spark.createDataFrame(asks, "g string, x string, me string"), spark.createDataFrame(known, "g string, y string, slug string"), 3, 4).collect()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for g, x, me in asks:
        scored = [(-(1 - edits(x, y) / max(len(x), len(y))) if x or y else -1.0, s) for h, y, s in known if h == g and s != me] if x is not None else []
        best = min((p for p in scored if p[0] <= -0.75), default=None)
        if best:
            want[g, x, me] = (round(-best[0], 9), best[1])
    assert {(p["g"], p["x"], p["me"]): (round(p["score"], 9), p["slug"]) for p in got} == want and len(want) > 300
    assert left[0] < 100


def test_alike_rules_out_long_strings_of_one_language(spark):
    """Prose of one small vocabulary shares most of its characters; only true neighbours are left to the exact distance."""
    from lodestrand.operators import alike as module

    r = random.Random(5)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(60)]
    strings = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) for _ in range(60)]
    for s in strings[:20]:
        n = len(s) // 6
        spots = set(r.sample(range(len(s)), n))
        strings.append("".join(r.choice(("", "é", c + "x")) if i in spots else c for i, c in enumerate(s)))
    strings = sorted(set(strings))
    rows = spark.createDataFrame([("g", s, True, i % 2 == 0) for i, s in enumerate(strings)], "g string, s string, asks boolean, answers boolean")
    pairs = spark.createDataFrame([(a, b) for a in strings for b in strings[::2] if a != b], "x string, y string")
    want = {(p["x"], p["y"]) for p in pairs.where(text.similarity("x", "y") >= 0.75).collect()}
    assert {(p["x"], p["y"]) for p in module.alike(rows, 3, 4).where("x <> y").collect()} == want and len(want) >= 10
    assert module._met(rows, 3, 4).count() < 3 * len(want)
