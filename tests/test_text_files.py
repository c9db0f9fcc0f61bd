"""Folders of many small files."""

import pytest
from pyspark.sql import functions as F

from lodestrand.plans import vault
from lodestrand.sources import pages, text_files


def test_many_files_are_few_tasks(spark, tmp_path):
    folder = tmp_path / "wiki/concepts"
    folder.mkdir(parents=True)
    (tmp_path / "wiki/entities").mkdir()
    for i in range(400):
        (folder / f"p {i}.md").write_text(f"text {i}\n")
    for hidden in (".p.md", "_p.md", "p.txt"):
        (folder / hidden).write_text("no")
    (tmp_path / "wiki/entities/empty.md").write_text("")
    read = pages.read_pages(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 4
    assert {tuple(r) for r in read.collect()} == {("concepts", f"p {i}", f"text {i}\n") for i in range(400)} | {("entities", "empty", "")}
    assert pages.read_pages(spark, f"file://{tmp_path}").count() == 401


def test_files_that_are_no_text(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_bytes(b"\xffx")
    got = text_files.read_files(spark, [str(tmp_path)], ".md").select("name", F.hex(F.col("text").cast("binary"))).collect()
    assert [tuple(r) for r in got] == [("a.md", "FF78")]
    with pytest.raises(Exception, match="No such file"):
        text_files.read_files(spark, [str(tmp_path / "none")], ".md").collect()


def test_the_index_does_not_pass_the_driver(spark, tmp_path, monkeypatch):
    page = lambda *slugs: spark.createDataFrame([("concepts", s, None, "x") for s in slugs], "kind_dir string, slug string, front string, body string")
    v = vault.Vault(spark, str(tmp_path / "vault"))
    v.load(page("a"))
    before = v.snapshot().index()

    def not_here(self):
        raise AssertionError("collected")

    with monkeypatch.context() as m:
        m.setattr(vault.Snapshot, "index", not_here)
        v.load(page("b"))
        v.export(str(tmp_path / "out"))
    after = (tmp_path / "out/wiki/index.md").read_text()
    assert after == v.snapshot().index() == before.replace("- [[concepts/a]] · a\n", "- [[concepts/a]] · a\n- [[concepts/b]] · b\n")


def test_front_matter_reaches_python_by_few_rows(spark):
    texts = ["a: 1\nb:\n  z: x\n  y: [1, null]\n", "- x\n", "a: .inf\n", "", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    there = rows.withColumn("e", pages.yaml_to_entries("t"))
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # a hundred rows at a time
    back = there.withColumn("back", pages.entries_to_yaml("e")).orderBy("n").select("e", "back").collect()
    assert [tuple(r) for r in back] == [('[["a", 1], ["b", {"z": "x", "y": [1, null]}]]', "a: 1\nb:\n  z: x\n  y:\n  - 1\n  - null\n"), (None, None), (None, None), ("[]", None), (None, None)]
