"""Token-count rollups kept up to date by signed deltas.

A ledger is a folder of committed batches in the shared store. A batch holds, for each (source, lang, tokenizer), the signed
sums of documents, tokens and bytes of its changes: inserts count +1, deletes -1, a revision -1 for the old counts and +1 for the
new. Totals are the sums over all committed batches. A batch is named by its caller: committing a name again changes
nothing, and a batch whose write broke off is written anew, since only a finished write leaves its marker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, scratch_root, table
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


class TokenLedger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        files, root = self._files(self.root)
        if not files.exists(root):
            return []
        return sorted(n for n in (x.getPath().getName() for x in files.listStatus(root)) if self.is_committed(n))

    def is_committed(self, batch: str) -> bool:
        files, marker = self._files(f"{self.root}/{batch}/_SUCCESS")
        return files.exists(marker)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes(source, lang, tokenizer, sign, tokens, bytes); False if it was committed before.

        Null sources, languages and tokenizers are keys like any other; null tokens and bytes count 0; rows without sign are
        ignored. Further columns are ignored; an empty batch is committed and adds nothing.
        """
        if self.is_committed(batch):
            return False
        signed = lambda c: F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
        sums = changes.where("sign IS NOT NULL").groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), signed("tokens"), signed("bytes"))
        sums.write.mode("overwrite").parquet(f"{self.root}/{batch}")
        return True

    def totals(self) -> DataFrame:
        """One row per key that some document is left of: source, lang, tokenizer, docs, tokens, bytes."""
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], TOTALS)
        deltas = self.spark.read.schema(TOTALS).parquet(*[f"{self.root}/{b}" for b in batches])
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "bytes")])
        return sums.where("docs <> 0 OR tokens <> 0 OR bytes <> 0")


def count_tokens(docs: DataFrame, tokenizers: tuple[str, ...], text_col: str = "text", paths: dict[str, str] | None = None) -> DataFrame:
    """The rows of docs, without the text, with one count column per tokenizer and the text's bytes. Null texts have none. Input
    columns with the names of the new ones are replaced."""
    new = [*tokenizers, "bytes"]
    rest = [c for c in docs.columns if c != text_col and c not in new]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(n, T.LongType()) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(t, (paths or {}).get(t)) for t in tokenizers]
        for batch in batches:
            texts = [x or "" for x in batch.column(len(rest)).to_pylist()]
            counts = [pa.array([e.count(t) for t in texts], pa.int64()) for e in encoders]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *counts, pa.array([len(t.encode()) for t in texts], pa.int64())], names=[*rest, *new])
        for e in encoders:
            e.rest()

    return docs.select(*rest, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def as_changes(counts: DataFrame, tokenizers: tuple[str, ...], sign: int) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(t).alias("tokens")) for t in tokenizers])).alias("t")
    return counts.select("source", "lang", "bytes", each).select("source", "lang", "t.*", F.lit(sign).alias("sign"), "bytes")


TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")


#: Three or more of one sign in a row, which the clean-up turns into one.
SIGN_RUNS = r"(?U)([^\w\s])\1\1+"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions; those labelled toxic are deleted, and those left that have runs of signs
    are revised to their text without. The deletion is committed twice, to no effect. Texts are counted where they lie, and only counts
    meet the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    counts, _ = scratch(count_tokens(docs, TOKENIZERS))
    messy = docs.where(F.col("text").rlike(SIGN_RUNS))
    before, _ = scratch(count_tokens(messy, TOKENIZERS))
    after, _ = scratch(count_tokens(messy.withColumn("text", F.regexp_replace("text", SIGN_RUNS, "$1")), TOKENIZERS))
    left = lambda c: c.join(toxic, "doc_id", "left_anti")
    ledger = TokenLedger(spark, f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit("load", as_changes(counts, TOKENIZERS, 1))
    takedown = as_changes(counts.join(toxic, "doc_id", "left_semi"), TOKENIZERS, -1)
    ledger.commit("takedown", takedown)
    ledger.commit("cleanup", as_changes(left(before), TOKENIZERS, -1).unionByName(as_changes(left(after), TOKENIZERS, 1)))
    ledger.commit("takedown", takedown)
    return ledger.totals()
