"""The corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of documents.
SQL can't express the first stage, nor those after it on its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.decontamination import drop_leaks
from lodestrand.llm.exact_dedup import exact_dedup
from lodestrand.llm.near_dedup import drop_near_copies
from lodestrand.llm.packing import pack_documents
from lodestrand.llm.shared import scratch, table
from lodestrand.llm.toxicity import fit_on_labels, score_toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more; labels of held-out ids aren't learnt from.

    Null and empty texts get the share of toxic labels among texts without words. Rows equal in text share their fate, repeats included. Null ids
    are kept or dropped by their text. Extra columns stay, whatever their names. An empty table, or one without labels, gives the rows as they are.
    """
    return score_toxicity(docs, fit_on_labels(spark, docs, sf_dir), carry=True).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: the one with the largest id, null ids last, one of those that tie.

    Null texts count as empty, so one of all such is kept. Extra columns stay; of rows equal in id and text any one's stand. An empty table
    gives an empty one.
    """
    return exact_dedup(docs, keep="largest", carry=True).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least id, null ids last.

    Texts without words, null included, are alike only if equal. Of rows equal in id and text one is kept. Extra columns stay, whatever
    their names. An empty table gives an empty one.
    """
    return drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or nearly.

    Null and empty texts and items match nothing, nor do items of under five words. Rows that share an id, null included, share its fate. Extra
    columns stay. An empty table gives an empty one; an empty benchmark drops nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, a row per piece.

    A null text is empty and takes one token, its end. Null, repeated and tied rows are packed like any others. Extra columns are left out. An empty
    table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = scratch(stage(spark, docs, sf_dir))
    return docs
