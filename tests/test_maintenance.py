"""Requests of the maintenance jobs, packaged templates, and the store of responses."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import PageFormat
from lodestrand.operators import requests, responses
from lodestrand.plans import jobs
from lodestrand.sources import runs

FMT = PageFormat()


def block(n):
    return f"{FMT.open}{n} -->\ntext {n}\n{FMT.close}"


PAGES = [
    ("concepts", "one", '[["title", "One"], ["n", 1]]', f"# One\n\n{block('a')}\n\n{block('b')}\nfoot"),
    ("concepts", "two", None, f"{block('c')}"),
    ("entities", "one", '[["title", 3]]', "no block " * 50),
    ("entities", "empty", "[]", ""),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "kind_dir string, slug string, front string, body string")


def made(frame, *key):
    rows = frame.collect()
    assert all(len(r["request_id"]) == 64 for r in rows)
    return {tuple(r[k] for k in key): r["user"] for r in rows}


def test_page_requests(pages):
    template = runs.Template("S", "{{ page_title }} {{ fragments | length }}:{% for f in fragments %} {{ loop.index }}/{{ loop.length }}{% if loop.last %}!{% endif %} {{ f }}{% endfor %}", "m", 7)
    got = jobs.maintenance_requests("consolidate", pages, template)
    assert made(got, "kind_dir", "slug") == {("concepts", "one"): "One 2: 1/2 text a 2/2! text b"}
    row = got.first()
    assert (row["op"], row["system"], row["model"], row["max_tokens"]) == ("consolidate", "S", "m", 7)
    got = made(jobs.maintenance_requests("rewrite", pages, runs.Template("S", "{{ slug }}|{{ title }}|{{ body }}")), "kind_dir", "slug")
    assert got == {("concepts", "one"): "one|One|text a", ("concepts", "two"): "two|two|text c"}
    got = made(jobs.maintenance_requests("audit", pages, runs.Template("S", "{{ slug }}|{{ page_type }}|{{ title }}|{{ body }}")), "kind_dir", "slug")
    assert got == {(k, s): f"{s}|{k}|{'One' if (k, s) == ('concepts', 'one') else s}|{b}" for k, s, _, b in PAGES}  # a number is no title
    with pytest.raises(ValueError):
        jobs.maintenance_requests("other", pages, template)


def test_lint_requests_hold_whole_files(spark, pages):
    template = runs.Template("S", "{{ slug_a }}/{{ title_a }}:{{ body_a }}\n{{ slug_b }}/{{ title_b }}:{{ body_b }}")
    file = {("concepts", "one"): f"---\ntitle: One\nn: 1\n---\n\n{PAGES[0][3]}", ("concepts", "two"): PAGES[1][3], ("entities", "one"): f"---\ntitle: 3\n---\n\n{PAGES[2][3]}", ("entities", "empty"): ""}
    title = {k: "One" if k == ("concepts", "one") else k[1] for k in file}
    keys = list(file)
    asked = [(*keys[a], *keys[b]) for a in range(4) for b in range(4) if a != b] + [("concepts", "gone", "concepts", "one")]
    pairs = spark.createDataFrame(asked, "kind_a string, slug_a string, kind_b string, slug_b string")
    got = made(jobs.maintenance_requests("lint", pages, template, pairs), *requests.PAIR)
    assert got == {(*a, *b): f"{a[1]}/{title[a]}:{file[a]}\n{b[1]}/{title[b]}:{file[b]}" for a in keys for b in keys if a != b}
    # Without pairs, the candidates of the lint job are asked about.
    near = spark.createDataFrame([("concepts", "lantern-oil", "[]", "x"), ("concepts", "lantern-oils", "[]", "y"), ("concepts", "other", "[]", "z")], pages.schema)
    assert list(made(jobs.maintenance_requests("lint", near, template), "slug_a", "slug_b")) == [("lantern-oil", "lantern-oils")]


def test_names_that_are_not_there(spark):
    rows = spark.createDataFrame([("x", ["a"])], "t string, l array<string>")
    known = {"t": (F.col("t"), T.StringType()), "l": (F.col("l"), T.ArrayType(T.StringType()))}
    for source in ("{{ u }}", "{{ t.a }}", "{% if u %}x{% endif %}", "{% for f in l %}{{ loop.nth }}{% endfor %}", "{{ loop.index }}", "{% for f in u %}x{% endfor %}"):
        with pytest.raises(ValueError, match="unknown name"):
            requests.TextTemplate(source).render(**known)
    nested = "{% for a in l %}{% for b in l %}{{ loop.index0 }}{% endfor %}{{ loop.index }}{% if loop.first %}f{% endif %}{% endfor %}"
    assert rows.select(F.array("t", "t").alias("l")).select(requests.TextTemplate(nested).render(l=known["l"])).first()[0] == "011f012"


def test_packaged_templates(spark, pages, tmp_path):
    folder = str(tmp_path / "prompts")
    names = runs.install_templates(folder)
    assert len(names) == 8 and runs.install_templates(folder) == []
    (tmp_path / "prompts/lint.toml").write_text('[prompt]\nsystem = "mine"\nuser_template = "{{ slug_a }}"\n')
    os.unlink(tmp_path / "prompts/audit.toml")
    assert runs.install_templates(folder) == ["audit.toml"] and runs.Template.load(folder, base="lint").system == "mine"
    for op in ("audit", "consolidate", "rewrite"):
        assert not jobs.maintenance_requests(op, pages, runs.Template.load(folder, base=op)).isEmpty()
    recipe = runs.Template.load(folder, "dev-journal")
    assert recipe.max_facts == 12 and recipe.caps["assistant_message"] == 16384 and "traps" in recipe.system
    events = spark.createDataFrame([(1, json.dumps({"type": "user", "sessionId": "s", "uuid": "u", "cwd": "/w", "message": {"role": "user", "content": "hello"}}))], "line_no int, raw string")
    from lodestrand.sources import transcripts

    user = jobs.prepare(transcripts.parse_events(events)[0], spark.createDataFrame([], "kind_dir string, slug string, title string, summary string"), recipe).requests.first()["user"]
    assert "No more than 12 facts." in user and "<user>\nhello" in user and "in /w" in user


# ---- responses ------------------------------------------------------------------------------------------------------


def asked(spark, n):
    rows = [(f"{i:02x}{i:062x}", "sys", f"user {i}") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "request_id string, system string, user string").repartition(4)


def provider(log, fails=lambda user, tried: False):
    """Notes each call in a file of its own; fails as told."""
    log = str(log)

    def call(system, user):
        import uuid

        name = user.replace(" ", "-")
        tried = len([x for x in os.listdir(log) if x.startswith(f"{name}.")])
        with open(f"{log}/{name}.{uuid.uuid4().hex}", "w") as f:
            f.write(system)
        if fails(user, tried):
            raise RuntimeError(f"no answer to {user}")
        return {"text": f"said {user}", "input_tokens": len(user)}

    return call


def calls(log):
    from collections import Counter

    return Counter(x.split(".")[0] for x in os.listdir(log))


def test_each_request_is_answered_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = responses.ResponseStore(spark, str(tmp_path / "store"))
    flaky = provider(log, lambda user, tried: int(user.split()[1]) % 3 == 0 and tried == 0)
    got = {r["request_id"][:2]: r for r in store.fill(asked(spark, 12), flaky, pause=0.0).collect()}
    assert len(got) == 12 and got["05"]["text"] == "said user 5" and got["05"]["input_tokens"] == 6 and got["05"]["output_tokens"] is None
    assert (got["03"]["tries"], got["04"]["tries"], got["03"]["error"]) == (2, 1, None)
    assert sum(calls(log).values()) == 12 + 4
    again = store.fill(asked(spark, 14), flaky, pause=0.0)
    rows = {r["request_id"][:2]: (r["text"], r["tries"]) for r in again.collect()}
    assert sum(calls(log).values()) == 16 + 3 and rows["03"] == ("said user 3", 0)  # 12 fails once, 13 doesn't
    # Working on the result again finds the stored files.
    assert again.count() == 14 and sum(calls(log).values()) == 19
    store.compact()
    assert not os.path.exists(tmp_path / "store/new") and store.complete(asked(spark, 14), flaky).count() == 14 and sum(calls(log).values()) == 19
    assert store.complete(asked(spark, 16), provider(log), per_second=1000.0).count() == 16
    store.compact()
    assert store.answers().count() == 16


def test_broken_runs_go_on_where_they_stopped(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = responses.ResponseStore(spark, str(tmp_path / "store"))

    class Stop(BaseException):
        pass

    inner = provider(log)

    def dies(system, user):
        if user == "user 7":
            raise Stop("worker lost")  # no answer's error: the task fails
        return inner(system, user)

    with pytest.raises(Exception, match="worker lost"):
        store.complete(asked(spark, 20).coalesce(1), dies)
    before = calls(log)
    assert 0 < len(before) < 20 and set(before.values()) == {1}
    assert store.complete(asked(spark, 20), inner).count() == 20
    assert set(calls(log).values()) == {1} and len(calls(log)) == 20


def test_failures_are_rows_and_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    store = responses.ResponseStore(spark, str(tmp_path / "store"))
    never = provider(log, lambda user, tried: user == "user 1" and tried < 5)
    got = {r["request_id"][:2]: r for r in store.fill(asked(spark, 3), never, tries=2, pause=0.0).collect()}
    assert (got["01"]["text"], got["01"]["error"], got["01"]["tries"]) == (None, "no answer to user 1", 2) and store.answers().count() == 2
    assert store.complete(asked(spark, 3), never, tries=2, pause=0.0).count() == 2
    assert store.complete(asked(spark, 3), never, tries=2, pause=0.0).count() == 3 and calls(log)["user-1"] == 6
    assert responses.ResponseStore(spark, str(tmp_path / "none")).answers().isEmpty()


# ---- folds ----------------------------------------------------------------------------------------------------------


def fold(rows):
    gone, out = set(), set()
    for n, a, b, winner in sorted(rows):
        if a in gone or b in gone or winner not in (a[1], b[1]):
            continue
        won, lost = (a, b) if winner == a[1] else (b, a)
        gone.add(lost)
        out.add((n, *won, *lost))
    return out


def test_fold_in_rounds_equals_the_sequence(spark):
    import random

    from lodestrand.operators import near_pages

    r = random.Random(4)
    cases = []
    for size, pages in ((150, 40), (150, 600)):
        name = lambda: (r.choice("ce"), f"p{r.randrange(pages)}")
        rows = [(n, *r.sample(sorted({name() for _ in range(6)}), 2)) for n in range(size)]
        cases.append([(n, a, b, r.choice([a[1], b[1], b[1], "none"])) for n, a, b in rows])
    cases.append([(n, ("c", "hub"), ("c", f"p{n}"), "hub" if n < 110 else f"p{n}") for n in range(120)])  # one winner of many, in the end beaten
    cases.append([(n, ("c", f"p{n}"), ("c", f"p{n + 1}"), f"p{n}") for n in range(14)])  # a chain, each link of which undoes the next
    for rows in cases:
        df = spark.createDataFrame([(n, *a, *b, "merge", w) for n, a, b, w in rows] + [(10_000, "c", "hub", "c", "p1", "keep", "hub")], "ord int, kind_a string, slug_a string, kind_b string, slug_b string, verdict string, winner string")
        want = fold(rows)
        assert {tuple(x) for x in near_pages.killset_fold(df, 10).collect()} == want == {tuple(x) for x in near_pages.killset_fold(df).collect()}


# ---- files of sessions and runs -------------------------------------------------------------------------------------


def test_sessions_keep_files_until_they_end(spark, tmp_path):
    from lodestrand.streaming import lifecycle, session_files

    transcript = tmp_path / "t.jsonl"
    transcript.write_text("é 1\n")
    settings = json.dumps({"model": "m"})

    def rows(*events):
        made = [(s, e, f"2026-05-01 10:00:{n:02d}", "2026-05-01 10:00:00", "/w", path, None, settings, snap, [], True) for n, (s, e, path, snap) in enumerate(events)]
        names = [c.split()[0] for c in lifecycle.ROWS.split(", ")]
        frame = spark.createDataFrame(made, "session_id string, event string, at string, started_at string, cwd string, transcript_path string, skip_reason string, settings string, snapshot string, snapshots array<string>, open boolean")
        session_files.keep_files(frame.select(*[F.col(c).cast("timestamp") if c in ("at", "started_at") else F.col(c) for c in names]), str(tmp_path / "cache"))

    there = lambda: sorted(str(p.relative_to(tmp_path / "cache/sessions")) for p in (tmp_path / "cache/sessions").rglob("*") if p.is_file())
    t = str(transcript)
    first = [("a", "SessionStart", t, None), ("a", "PreCompact", t, "0001.jsonl"), ("b", "SessionStart", t, None), ("b", "PreCompact", str(tmp_path / "none"), "0001.jsonl"), ("../x", "SessionStart", t, None)]
    for _ in range(2):  # again, as after a failure
        rows(*first)
        assert there() == ["a/resolved.json", "a/snapshots/0001.jsonl", "b/resolved.json"]
    assert json.loads((tmp_path / "cache/sessions/a/resolved.json").read_text())["model"] == "m" and (tmp_path / "cache/sessions/a/snapshots/0001.jsonl").read_text() == "é 1\n"
    transcript.write_text("2\n" * 100_000)
    rows(("a", "PreCompact", f"file://{t}", "0002.jsonl"), ("a", "Stop", t, None), ("b", "Expired", t, None), ("c", "SessionEnd", t, None))
    assert there() == ["a/resolved.json", "a/snapshots/0001.jsonl", "a/snapshots/0002.jsonl"] and (tmp_path / "cache/sessions/a/snapshots/0002.jsonl").stat().st_size == 200_000
    rows(("a", "PreCompact", t, "0003.jsonl"), ("a", "SessionEnd", t, None))
    assert there() == []


def test_stages_are_dumped(spark, tmp_path):
    from lodestrand.sources import transcripts

    events = spark.createDataFrame([(1, json.dumps({"type": "user", "sessionId": "s", "uuid": "u", "message": {"role": "user", "content": "hello"}}))], "line_no int, raw string")
    ready = jobs.prepare(transcripts.parse_events(events)[0], spark.createDataFrame([], "kind_dir string, slug string, title string, summary string"), runs.Template("S", "{{ transcript.session_id }}"))
    said = ready.requests.select("request_id", F.lit('{"title": "T", "extracted": []}').alias("text"))
    assert jobs.dump_stages(ready, said, str(tmp_path / "d")) == {}
    assert spark.read.json(str(tmp_path / "d/requests")).first()["user"] == "s" and spark.read.json(str(tmp_path / "d/outputs")).first()["title"] == "T"
    broken = jobs.Prepared(ready.metadata.select(F.raise_error(F.lit("no")).alias("x")), ready.messages, ready.calls, ready.requests)
    assert list(jobs.dump_stages(broken, said, str(tmp_path / "e"))) == ["metadata"] and spark.read.json(str(tmp_path / "e/raw_output")).count() == 1
