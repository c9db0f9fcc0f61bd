"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the head of their normalised bytes and a digest of the rest, each
partition is sorted externally, and the window operator compares every row's full text with its neighbour's to find runs
of equal texts. Only the short sort keys are sampled, never texts.

A text that fills more than a quarter of a partition is dealt over `salts` sub-runs; its totals come from a grouped
aggregate that combines before it shuffles. There are at most four such texts for each partition, so their totals may
be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, table, text_or_empty, utf8

HEAD_BYTES = 32


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    carry: bool = False,
    salts: int = 64,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and, with carry, the input row as struct `row`.

    Texts are equal if their normalised forms are the same bytes; null is the empty text. Of equal texts the row with the
    smallest (keep="largest": largest) id stays. Null ids lose against any other; in a group of null ids one row stays
    and keep_id is null. Of rows equal in id and text exactly one stays. An empty table gives an empty result. Input
    columns of any name are safe: they travel inside `row`.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    best, order = (F.min, F.col("id").asc_nulls_last()) if keep == "smallest" else (F.max, F.col("id").desc_nulls_last())
    body = text_or_empty(text_col)
    body = normalise(body) if normalise else body
    whole = normalise is not None  # else the text travels once, as body
    rest = [F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == text_col and not whole else F.col(c) for c in docs.columns]
    rows = docs.select(F.col(id_col).alias("id"), utf8(body).alias("body"), *([F.struct(*rest).alias("row"), F.col(text_col).isNull().alias("blank")] if carry else []))

    digest = F.xxhash64("body")
    total = docs.count()
    hot = rows.groupBy(digest.alias("digest")).count().where(F.col("count") > max(64, total // (4 * parts))).select("digest", F.lit(True).alias("is_hot"))
    rows = rows.join(F.broadcast(hot), digest == F.col("digest"), "left").drop("digest")
    rows = rows.withColumns({"is_hot": F.coalesce("is_hot", F.lit(False)), "sha": F.sha2("body", 256)})
    hot_totals = (
        rows.where("is_hot").groupBy("body").agg(best("id").alias("hot_keep"), F.count("*").alias("hot_size")).select(F.sha2("body", 256).alias("hot_sha"), "hot_keep", "hot_size")
    )

    keys = {"head": F.substring("body", 1, HEAD_BYTES), "salt": F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0)}
    ranged = rows.withColumns(keys).repartitionByRange(parts, "head", "sha", "salt")
    run = Window.partitionBy("head", "sha", "salt", "body")
    runs = ranged.select(
        "id", "sha", "is_hot", *([_restored(docs.columns, text_col, whole).alias("row")] if carry else []),
        best("id").over(run).alias("run_keep"), F.count("*").over(run).alias("run_size"), F.row_number().over(run.orderBy(order)).alias("nth"),
    )
    merged = runs.join(F.broadcast(hot_totals), F.col("is_hot") & (F.col("sha") == F.col("hot_sha")), "left")
    keep_id = F.when(F.col("is_hot"), F.col("hot_keep")).otherwise(F.col("run_keep"))
    return merged.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("is_hot"), F.col("hot_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("nth") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def _restored(columns: list[str], text_col: str, whole: bool) -> Column:
    text = F.col("row").getField(text_col) if whole else F.when(~F.col("blank"), F.col("body").cast("string"))
    return F.struct(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over all documents, the largest id of equal texts staying; nulls, repeats, empty tables and extra columns as there."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
