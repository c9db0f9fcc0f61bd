"""Pages as files and as a store of whole transactions: round trips, tasks that break, writers that race."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.paths import canonical, canonical_text
from lodestrand.operators import sessions
from lodestrand.plans import jobs, vault
from lodestrand.sources import pages as page_source
from lodestrand.sources import runs, text_files



def now():
    return F.to_timestamp(F.lit("2026-05-10 10:30:00"))


TYPED = """title: A page
tags:
- a
- 1
priority: 3
draft: true
note: null
day: 2024-01-05
code: 007
share: 0.5
sure: yes
text: '3'
owner:
  zeta: 1
  alpha:
  - x
  - when: 2024-01-05
    fine: false
1: one
"""


def parsed(spark, *texts):
    return page_source.parse_pages(spark.createDataFrame([("concepts", f"p{n}", t) for n, t in enumerate(texts)], "kind_dir string, slug string, raw string"))


def test_front_matter_comes_back_as_it_was(spark):
    page = f"---\n{TYPED}---\n\n# A\n\nbody\n"
    pages = ["# plain\n", page, "---\nopen: 1\n", "---\na: 1\n---", "---\nkey: x\n---\n", "", "---\nb: 2\n---\n\n\n two blank lines\n"]
    got = parsed(spark, *pages).select("slug", "front", "body", page_source.render_page("front", "body").alias("text")).orderBy("slug").collect()
    assert [g["text"] for g in got] == [*pages[:3], "---\na: 1\n---\n", *pages[4:]]
    assert got[1]["body"] == "# A\n\nbody\n" and got[6]["body"] == "\n two blank lines\n" and got[2]["front"] is None
    front = dict(json.loads(got[1]["front"])[:-1])
    assert front["priority"] == 3 and front["draft"] is True and front["note"] is None and front["day"] == "2024-01-05" and front["code"] == "007" and front["share"] == 0.5 and front["sure"] == "yes" and front["text"] == "3"
    # A maintenance edit touches its key only: types, order and nested order stay.
    edited = parsed(spark, page).select(page_source.render_page(page_source.set_front("front", "priority", F.lit("4")), F.col("body")).alias("text")).first()["text"]
    assert edited == page.replace("priority: 3", "priority: '4'")
    added = parsed(spark, page).select(page_source.render_page(page_source.set_front("front", "updated", F.lit("2026-05-10")), F.col("body")).alias("text")).first()["text"]
    assert added == page.replace("1: one\n", "1: one\nupdated: 2026-05-10\n")


def test_fences(spark):
    texts = ["---\na: 1\n--- \nb: 2\n---\nx", "---\r\na: 1\r\n---\r\n\r\nx\r\n", "--- \na: 1\n---\nx", " ---\na: 1\n---\n", "---\n---\nx", "---\na: [\n---\nx", "---\na: 1\na: 2\n---\n", "---\n- a\n---\n", "---\nx: ---\n---\ny"]
    got = parsed(spark, *texts).orderBy("slug").collect()
    assert [(g["front"], g["body"], g["bad_front"]) for g in got] == [
        (None, "x", True), ('[["a", 1]]', "x\r\n", False), (None, texts[2], False), (None, texts[3], False), ("[]", "x", False), (None, "x", True), (None, "", True), (None, "", True), ('[["x", "---"]]', "y", False),
    ]
    assert page_source.topics(parsed(spark, "---\ntitle: 12\n---\nnumbers are no titles", "---\ntitle: T\n---\nx")).select("title").collect() == [("p0",), ("T",)]


def test_merge_keeps_typed_user_keys_and_drops_ill_typed_tags(spark):
    from lodestrand.operators import pages

    page = pages.Page(json.loads(page_source._entries(TYPED)), "b", pages.PageFormat(), "_engine")
    page.apply({"page_title": "T", "kind": "concept", "relations": {}, "body_markdown": "x"}, "i1", "[[s]]", "2026-05-10")
    out = page_source._front_text(json.dumps(list(page.front.items())))
    assert page.front["tags"] == ["a"]  # the number among the tags is no tag
    kept = TYPED[TYPED.index("priority") :]
    assert out.endswith(kept) and out.startswith("title: T\ntype: concept\n")


def test_files_are_whole_and_come_back(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"wiki/{'concepts' if n % 2 else 'entities'}/p{n}.md", f"---\ntitle: P{n}\n---\n\nbody {n}\n" + "é" * n) for n in range(200)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(5)
    text_files.write_files(df, root)
    read = page_source.read_pages(spark, root)
    assert {(f"wiki/{r['kind_dir']}/{r['slug']}.md", r["raw"]) for r in read.collect()} == set(rows)
    text_files.write_files(spark.createDataFrame([("wiki/concepts/p1.md", None), ("wiki/concepts/none.md", None), ("wiki/entities/p0.md", "new")], "path string, text string"), root)
    assert page_source.read_pages(spark, root).count() == 199 and (tmp_path / "out/wiki/entities/p0.md").read_text() == "new"
    assert not [x for x in os.listdir(root) if x.startswith(text_files.STAGING)]
    for bad in ("../x", "/x", "", "a/../../x"):
        with pytest.raises(Exception, match="not a path below"):
            text_files.write_files(spark.createDataFrame([(bad, "t")], "path string, text string"), root)


def test_files_that_are_no_text_are_rejected_whole(spark, tmp_path):
    from lodestrand.sources import transcripts

    line = lambda n: json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{n}", "message": {"role": "user", "content": "é"}}, ensure_ascii=False).encode() + b"\n"
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "0001.jsonl").write_bytes(line(1))
    (folder / "0002.jsonl").write_bytes(line(2) + b'{"type":"user\xff"}\n' + line(3) + b"\xfe\n")
    (folder / "0003.jsonl").write_bytes(line(4) + b"bad\n")
    (tmp_path / "s.jsonl").write_bytes(line(5))
    events, rejects = transcripts.scan_snapshots(spark, str(folder), str(tmp_path / "s.jsonl"))
    assert sorted((r["uuid"], r["source_rank"]) for r in events.collect()) == [("u1", 1), ("u4", 3), ("u5", transcripts.FINAL_RANK)]
    assert sorted((r["source_rank"], r["line_no"], r["reason"]) for r in rejects.collect()) == [(2, 2, "not UTF-8"), (3, 2, "not JSON")]
    good, bad = transcripts.readable(transcripts.read_lines(spark, str(folder)))
    assert good.count() == 3 and [(os.path.basename(r["path"]), r["line_no"]) for r in bad.collect()] == [("0002.jsonl", 2)]
    (tmp_path / "s.jsonl").write_bytes(b"\xff\n")
    with pytest.raises(Exception, match="not UTF-8"):
        transcripts.scan_transcript(spark, str(tmp_path / "s.jsonl"))[0].collect()


def test_stored_sessions_need_no_shuffle(spark, tmp_path):
    from lodestrand.sources import sinks, transcripts

    lines = [(r, n, json.dumps({"type": "user", "sessionId": f"s{n % 7}", "uuid": f"u{n}", **({"timestamp": f"2026-01-0{1 + n % 9}T00:00:00Z"} if n % 5 else {}), "message": {"role": "user", "content": "x"}})) for r in (1, 2) for n in range(60)]
    events, _ = transcripts.parse_events(spark.createDataFrame(lines, "source_rank int, line_no int, raw string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql("DROP TABLE IF EXISTS stored_sessions")
        stored = sinks.store_sessions(events, "stored_sessions", 3)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        meta, merged = sessions.session_metadata(stored), sessions.merge_snapshots(stored)
        joined = stored.join(meta, "session_id")
        assert not any("Exchange" in plan(df) for df in (meta, merged, joined)) and "Exchange" in plan(sessions.session_metadata(events))
        assert sorted(map(str, meta.collect())) == sorted(map(str, sessions.session_metadata(events).collect())) and merged.count() == 60
        files = stored.select("session_id", "ts_raw", F.input_file_name().alias("f")).collect()
        for name in {r["f"] for r in files}:
            order = [(r["session_id"], r["ts_raw"] is None, r["ts_raw"] or "") for r in files if r["f"] == name]
            assert order == sorted(order)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_sessions")


def test_broken_tasks_leave_no_half_file(spark, tmp_path):
    root = tmp_path / "out"
    old, new = "old " * 50_000, "new " * 50_000
    paths = [f"a/p{n}.md" for n in range(40)]
    text_files.write_files(spark.createDataFrame([(p, old) for p in paths], "path string, text string"), str(root))

    @F.udf(T.StringType())
    def breaks(path):
        if path.endswith("p17.md"):
            raise RuntimeError("lost")
        return "new " * 50_000

    broken = spark.createDataFrame([(p,) for p in paths], "path string").repartition(4).withColumn("text", breaks("path"))
    with pytest.raises(Exception, match="lost"):
        text_files.write_files(broken, str(root))
    assert {(root / p).read_text() in (old, new) for p in paths} == {True} and (root / "a/p17.md").read_text() == old
    assert [x for x in os.listdir(root) if not x.startswith(text_files.STAGING)] == ["a"] and sorted(os.listdir(root / "a")) == sorted(os.path.basename(p) for p in paths)
    text_files.write_files(spark.createDataFrame([(p, new) for p in paths], "path string, text string"), str(root))
    assert {(root / p).read_text() for p in paths} == {new}


def test_canonical_paths(spark):
    texts = ["/a/b", "/a//b/", "/a/./b/.", "/a/../b", "/..", "/../../a", "/", "//", "a/../b", "", "/a/b/../../..", "/a/.../b", "/a/..b", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "p string").select(canonical("p")).collect()]
    want = [t if t is None or not t.startswith("/") else "/" + os.path.normpath(t).lstrip("/") for t in texts]
    assert got == want == [None if t is None else canonical_text(t) for t in texts]
    rows = spark.createDataFrame([("/x/../skip/a",), ("/skip/../x",), ("/skipped",), ("/skip",)], "cwd string")
    assert [(r["cwd"], r["skip_path"]) for r in sessions.skip_canonical(rows, ["/y/../skip//"]).collect()] == [("/x/../skip/a", "/skip"), ("/skip/../x", None), ("/skipped", None), ("/skip", "/skip")]


# ---- transactions ---------------------------------------------------------------------------------------------------

TEMPLATE = runs.Template("S", "{{ transcript.session_id }}")


def prepared(spark, *ids):
    from lodestrand.sources import transcripts

    lines = [(n, json.dumps({"type": "user", "sessionId": i, "uuid": f"{i}{n}", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "x"}})) for n, i in enumerate(ids)]
    events, _ = transcripts.parse_events(spark.createDataFrame(lines, "line_no int, raw string"))
    return jobs.prepare(events, spark.createDataFrame([], "kind_dir string, slug string, title string, summary string"), TEMPLATE)


def answers(spark, made, facts):
    """Responses whose facts are facts[session] = [(slug, title, summary), ...]."""
    said = {s: json.dumps({"title": f"About {s}", "tags": ["t"], "extracted": [{"type": "concept", "page_slug": a, "page_title": b, "summary": c, "body_markdown": f"{s} {c}"} for a, b, c in rows]}) for s, rows in facts.items()}
    rows = spark.createDataFrame(list(said.items()), "session_id string, text string")
    return made.requests.select("request_id", "session_id").join(rows, "session_id").select("request_id", "text")


def state_of(v):
    seen = v.snapshot()
    pages = {(r["kind_dir"], r["slug"]): (json.loads(r["front"] or "[]"), r["body"]) for r in seen.pages().collect()}
    rows = {t: sorted(map(str, seen.appended(t).collect())) for t in vault.APPENDED}
    return pages, rows, seen.index()


FACTS = {"one": [("lantern-oil", "Lantern oil", "first"), ("cache", "Cache", "c")], "two": [("lantern-oils", "Lantern oils", "second"), ("other-thing", "Other thing", "o")]}


def run_archive(spark, v, session, **options):
    made = prepared(spark, session)
    return vault.archive(v, made, answers(spark, made, {session: FACTS[session]}), now(), "2026-05-10", **options)


def test_transaction_is_all_or_nothing(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"))
    assert state_of(v)[2] is None and v.snapshot().mark is None
    v.load(spark.createDataFrame([("entities", "kept", page_source._entries(TYPED), "k\n")], vault.PAGES))
    run_archive(spark, v, "one")
    pages, rows, index = state_of(v)
    assert set(pages) == {("entities", "kept"), ("concepts", "lantern-oil"), ("concepts", "cache")} and all(len(rows[t]) == 1 for t in ("log", "raw", "records"))
    assert "[[concepts/cache]] · Cache" in index and "[[entities/kept]] · A page" in index
    before, marks = sorted(os.listdir(tmp_path / "v")), v.snapshot().folders

    def fails(seen):
        return vault.Change(pages=seen.pages().withColumn("body", F.lit("lost")), appended={"log": seen.appended("log").withColumn("title", F.raise_error(F.lit("broken")))})

    with pytest.raises(Exception, match="broken"):
        v.update(fails)
    assert sorted(os.listdir(tmp_path / "v")) == before and v.snapshot().folders == marks and state_of(v)[0] == pages
    v.export(str(tmp_path / "files"))
    text = (tmp_path / "files/wiki/entities/kept.md").read_text()
    assert text == f"---\n{TYPED}---\n\nk\n" and "About one" in (tmp_path / "files/wiki/log.md").read_text() and "- t\n" in (tmp_path / "files/raw/sessions/2026-05-10T10-30_one.md").read_text()


def test_racing_archives_leave_what_one_after_the_other_would(spark, tmp_path):
    """The second writer commits while the first is at work: the first sees its mark taken and resolves anew, onto the winner's page."""
    raced, tries = vault.Vault(spark, str(tmp_path / "raced")), []
    made = prepared(spark, "one")
    said = answers(spark, made, {"one": FACTS["one"]})

    class Slow(vault.Vault):
        def commit(self, seen, change):
            tries.append(seen.mark)
            if len(tries) == 1:
                run_archive(spark, raced, "two")
            return super().commit(seen, change)

    vault.archive(Slow(spark, raced.root), made, said, now(), "2026-05-10")
    pages, rows, index = state_of(raced)
    # As after "two" and then "one": one page for both spellings, with the winner's slug, the later title, both blocks in order and both sources.
    assert len(tries) == 2 and set(pages) == {("concepts", "lantern-oils"), ("concepts", "other-thing"), ("concepts", "cache")}
    front, body = pages["concepts", "lantern-oils"]
    assert dict(front)["title"] == "Lantern oil" and body.index("two second") < body.index("one first")
    assert dict(front)["sources"] == ["[[../raw/sessions/2026-05-10T10-30_one]]", "[[../raw/sessions/2026-05-10T10-30_two]]"]
    assert all(len(rows[t]) == 2 for t in ("log", "raw", "records")) and "[[concepts/lantern-oils]] · Lantern oil" in index
    assert raced.vacuum() >= 0 and state_of(raced) == (pages, rows, index)


def test_threads_that_race_lose_nothing(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"))
    ids = [f"w{n}" for n in range(4)]
    failed = []

    def work(name):
        try:
            v.update(lambda _: vault.Change(pages=spark.createDataFrame([("concepts", name, "[]", name), ("concepts", "shared", "[]", name)], vault.PAGES), appended={"maintenance": spark.createDataFrame([(1, name)], vault.APPENDED["maintenance"])}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in ids]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    pages, rows, index = state_of(v)
    assert not failed and {s for _, s in pages} == {*ids, "shared"} and len(rows["maintenance"]) == 4 and all(i in index for i in ids)
    folders = [x for x in os.listdir(tmp_path / "v") if x.startswith("v")]
    assert len(folders) == 4  # vain attempts leave nothing


def test_many_changes_become_a_base(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"))
    for n in range(vault.MOST_CHANGES + 3):
        v.update(lambda _, n=n: vault.Change(pages=spark.createDataFrame([("concepts", f"p{n % 5}", "[]", str(n))], vault.PAGES), gone=spark.createDataFrame([("concepts", f"p{(n + 1) % 5}")], "kind_dir string, slug string"), reindex=False))
    n = vault.MOST_CHANGES + 2
    folders = v.snapshot().folders
    assert len(folders["base"]) == 1 and len(folders["changes"]) < vault.MOST_CHANGES
    assert {s: b for (_, s), (_, b) in state_of(v)[0].items()} == {f"p{m % 5}": str(m) for m in range(n - 3, n + 1)}


def test_maintenance_as_transactions(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"))
    fmt = v.fmt
    block = lambda n: f"{fmt.open}{n} -->\ntext {n}\n{fmt.close}"
    body = f"# T\n\n{block('b1')}\n\nbetween\n\n{block('b2')}\n"
    v.load(spark.createDataFrame([("concepts", s, json.dumps([["title", s.upper()], ["updated", "2020-01-01"]]), body) for s in ("a", "b", "c", "d", "e")], vault.PAGES))
    said = lambda *rows: spark.createDataFrame([("concepts", s, t) for s, t in rows], "kind_dir string, slug string, text string")
    start = v.snapshot()
    vault.apply_consolidate(v, said(("a", "all in one"), ("none", "x")), now())
    vault.apply_rewrite(v, said(("b", "better"), ("c", "SKIP")), now())
    vault.apply_audit(v, said(("d", '{"verdict":"move-to-log","reason":"old","log_line":"was d"}'), ("e", '{"verdict":"keep"}')), now())
    pages, rows, index = state_of(v)
    got = {s: (dict(f)["updated"], b) for (_, s), (f, b) in pages.items()}
    assert set(got) == {"a", "b", "c", "e"} and "concepts/d" not in index
    assert got["a"][1].count(fmt.open) == 1 and "between" not in got["a"][1] and got["a"][0] == "2020-01-01"
    assert got["b"][0] == "2026-05-10" and "better" in got["b"][1] and "text b2" in got["b"][1] and got["c"] == ("2020-01-01", body)
    verdict = json.dumps({"decision": "merge", "winning_slug": "b", "merged_body": "both", "reason": "same"})
    decided = jobs.requests.parse_verdicts(spark.createDataFrame([(1, "concepts", "b", "concepts", "c", verdict), (2, "concepts", "d", "concepts", "e", verdict)], "ord int, kind_a string, slug_a string, kind_b string, slug_b string, text string"))
    vault.apply_lint(v, decided, now())
    pages, rows, index = state_of(v)
    assert {s for _, s in pages} == {"a", "b", "e"} and "both" in pages["concepts", "b"][1] and len(rows["maintenance"]) == 2 and "concepts/c" not in index
    v.export(str(tmp_path / "files"), since=start)
    assert sorted(os.listdir(tmp_path / "files/wiki/concepts")) == ["a.md", "b.md"]
