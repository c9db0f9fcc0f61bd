"""Corpus-wide statistics for the keys of each document, without a row per key.

Documents are dealt by hash into chunks of some megabytes of text. A chunk asks for the statistic of its distinct 64-bit keys with
one packed request per key range; each range adds up what all chunks report and answers every chunk in the order it
asked; the chunk's documents, which the same shuffle still holds, then meet the answers. Chunks grow in number with the corpus, not
in size, and so do ranges up to MOST_RANGES; beyond, the chunks are dealt into parts, and a range answers each part in a task of its
own. A key that every document has costs each range a number per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shuffle_partitions, tidy

CHUNK_BYTES, RANGE_BYTES, MOST_RANGES, FAN_IN = 8 << 20, 16 << 20, 4096, 256


def total_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return n, size or 0


def into_chunks(docs: DataFrame, size: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(id, text, ...) with the number of its chunk, dealt out by it."""
    chunks = max(1, -(-size // chunk_bytes))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).repartition(shuffle_partitions(docs.sparkSession), "chunk")


def ranges_for(docs: DataFrame, size: int) -> int:
    return max(shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES))


def tiles_for(docs: DataFrame, size: int) -> tuple[int, int]:
    """Ranges of keys, MOST_RANGES at most so that a chunk's request for a range stays worth a row, and parts of the chunks, so that
    what one part of the chunks asks of one range stays near RANGE_BYTES however large the corpus."""
    ranges = min(ranges_for(docs, size), max(MOST_RANGES, shuffle_partitions(docs.sparkSession)))
    return ranges, -(-size // (RANGE_BYTES * ranges)) or 1


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Key range of 64-bit keys; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


REQUEST = "range int, chunk int, keys binary, counts binary"


def request_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.Table:
    """keys: sorted, distinct. counts: what this chunk reports of each."""
    cuts = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
    rows = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    # Counts that are all 1 are left out.
    pack = lambda x: b"" if (x == 1).all() else x.astype("<u4").tobytes()
    return pa.table(
        {
            "range": pa.array([r for r, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()),
            "keys": pa.array([keys[a:b].astype("<u8").tobytes() for _, a, b in rows], pa.binary()), "counts": pa.array([pack(counts[a:b]) for _, a, b in rows], pa.binary()),
        }
    )


def _unpack(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = [np.frombuffer(x.as_py(), "<u8") for x in keys]
    return found, [np.frombuffer(x.as_py(), "<u4") if len(x.as_py()) else np.ones(len(k), "<u4") for x, k in zip(counts, found, strict=True)]


def answer(requests: DataFrame, value: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: int = 1) -> DataFrame:
    """(chunk, range, values) for each request: value(keys, totals) of the distinct keys of a range gives one number per key. With several
    parts, a range's totals are added up from what each part of the chunks reports, in rounds of FAN_IN, and sent to each part."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _unpack(table["keys"], table["counts"])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        values = value(distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64))[at]
        ends = np.cumsum([len(k) for k in keys])
        blobs = [values[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]
        tidy()
        return pa.table({"chunk": table["chunk"], "range": table["range"], "values": pa.array(blobs, pa.binary())})

    if parts == 1:
        return requests.groupBy("range").applyInArrow(run, "chunk int, range int, values binary")

    def add(table: pa.Table) -> pa.Table:
        keys, counts = _unpack(table["keys"], table["counts"])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(distinct)).astype("<u4")
        tidy()
        return pa.table({"range": table["range"][:1], "part": table["part"][:1], "keys": pa.array([distinct.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, totals = (x[0] if x else np.empty(0, "<u8") for x in _unpack(known["keys"], known["counts"]))
        values = value(keys, totals.astype(np.int64))
        blobs = [values[np.searchsorted(keys, np.frombuffer(x.as_py(), "<u8"))].tobytes() for x in asked["keys"]]
        tidy()
        return pa.table({"chunk": asked["chunk"], "range": asked["range"], "values": pa.array(blobs, pa.binary())})

    split = requests.withColumn("part", F.expr(f"chunk % {parts}"))
    sums, left = split.select("range", "part", "keys", "counts"), parts
    while True:
        sums = sums.groupBy("range", "part").applyInArrow(add, "range int, part int, keys binary, counts binary")
        if left == 1:
            break
        left = -(-left // FAN_IN)
        sums = sums.withColumn("part", F.expr(f"part % {left}"))
    known = sums.select("range", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return split.groupBy("range", "part").cogroup(known.groupBy("range", "part")).applyInArrow(reply, "chunk int, range int, values binary")


def answered(replies: pa.Table, dtype: str, column: str = "values") -> np.ndarray:
    """The values of a chunk's keys in their order, from its replies."""
    order = np.argsort(replies["range"].to_numpy(), kind="stable")
    blobs = replies[column].to_pylist()
    return np.concatenate([np.frombuffer(blobs[i], dtype) for i in order]) if len(order) else np.empty(0, dtype)


def request(chunks: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """Requests of all chunks: keys_of(documents of a chunk) gives sorted distinct keys and their counts there."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(table)
        tidy()
        return request_rows(table["chunk"][0].as_py(), keys, counts, ranges)

    return chunks.groupBy("chunk").applyInArrow(run, REQUEST)


def with_answers(chunks: DataFrame, replies: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """use(documents, replies) of every chunk."""

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        out = use(documents, answers)
        tidy()
        return out

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
