import corpus_pipeline
from lodestrand.llm.shared import scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = scratch(stage(spark, docs, SF))
        if name == "packing":
            assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
        else:
            assert docs.columns == columns and 0 < docs.count() <= before
            assert docs.join(table(spark, SF, "documents"), columns, "left_anti").count() == 0
            before = docs.count()
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == before
