"""The pipeline's stages on rows with nulls, empty and long texts, repeats and extra columns, and on empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from lodestrand.llm.shared import scratch

NAMES = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, kept boolean, word string, leaked_id long"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly watch from behind an old stone wall"


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    """Odd documents, some of them labelled, and a benchmark with odd items."""
    root = str(tmp_path_factory.mktemp("sf"))
    nasty = [(1000 + n, f"you utter blockhead number {n} go away blockhead") for n in range(12)]
    kind = [(2000 + n, f"a pleasant walk number {n} along the quiet river") for n in range(12)]
    rows = [(i, t, None, "s", 0, 1, "x", None, None, 5) for i, t in [*odd_rows, *nasty, *kind, (3000, f"before {ITEM} after"), (None, ITEM), (3001, None)]]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i < 2000)) for i, _ in nasty + kind] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (1, ITEM), (None, None), (2, ""), (3, "too short")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = {s[0]: s[1] for s in corpus_pipeline.STAGES}
    before = Counter(tuple(r) for r in docs.collect())
    for name in ("toxicity", "exact_dedup", "decontamination"):
        kept = everything[name](spark, docs, folder)
        assert kept.columns == docs.columns
        after = Counter(tuple(r) for r in kept.collect())
        assert after <= before, name
        texts = Counter(r[1] or "" for r in after.elements())
        if name == "toxicity":
            assert not any("blockhead" in t for t in texts) and sum("pleasant" in t for t in texts) == 12
        elif name == "exact_dedup":
            assert set(texts.values()) == {1} and set(texts) == {r[1] or "" for r in before}
        else:
            assert not any(ITEM in t for t in texts) and sum(after.values()) >= sum(before.values()) - 1 - sum(n for r, n in before.items() if r[0] is None)
    packed = everything["packing"](spark, docs, folder)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r[0] for r in before.elements())


def test_each_stage_on_an_empty_table(spark, folder):
    docs, _ = scratch(spark.read.parquet(f"{folder}/documents.parquet").limit(0))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
