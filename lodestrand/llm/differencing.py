"""Packing into windows of near-equal fill by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie, and what a document leaves over its full windows is one piece. Pieces are dealt into groups
of about `group_pieces`, and each group is packed on its own: its windows are as many as its tokens need, every piece begins as a
partial partition of its own, and the two partial partitions of greatest imbalance are merged, the fullest windows of one on the
emptiest of the other, until one is left. Where a window then exceeds the capacity, its end is cut off, and the window count rises by
what all that is cut off needs, which is differenced in the same way. So a document is cut at window ends only, and a group
leaves about two windows of padding.

Only a partition's windows that hold something are kept, sorted, and a window's content is a node of a binary forest, so a merge costs a
sort of two sorted runs. Repeated rows are told apart by their partition and their number among their equals there, which
doesn't hang on the order of rows; so equal rows are dealt into all groups, and a task that runs again deals alike.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, tidy
from .tokens import encoder

END_ID = 1


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, such that the windows' sums are nearly equal."""
    n = len(sizes)
    if windows <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    parts = [(np.asarray([s]), np.asarray([i])) for i, s in enumerate(sizes)]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    nodes, left, right = n, [], []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (sums, node), (other, other_node) = parts[a], parts[b]
        parts[a] = parts[b] = None
        other, other_node = other[::-1], other_node[::-1]
        if (met := len(sums) + len(other) - windows) > 0:  # a's emptiest windows take b's
            at = len(sums) - met
            made = np.arange(nodes, nodes + met)
            nodes += met
            left.append(node[at:])
            right.append(other_node[:met])
            sums = np.concatenate((sums[:at], sums[at:] + other[:met], other[met:]))
            node = np.concatenate((node[:at], made, other_node[met:]))
        else:
            sums, node = np.concatenate((sums, other)), np.concatenate((node, other_node))
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), len(parts)))
        parts.append((sums, node))
    where = np.empty(nodes, np.int64)
    where[parts[heap[0][1]][1]] = np.arange(len(parts[heap[0][1]][1]))
    if left:
        lefts, rights = np.concatenate(left), np.concatenate(right)
        for made in range(nodes - 1, n - 1, -1):  # a node's window is known before its parts' are
            where[lefts[made - n]] = where[rights[made - n]] = where[made]
    return where[:n]


def fill_windows(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of at most the capacity, each a list of (item, first, length): parts of the items, whose sizes are up to the capacity."""
    out: list[list[tuple[int, int, int]]] = []
    items = [(i, 0, int(s)) for i, s in enumerate(sizes)]
    while items:
        length = np.asarray([x[2] for x in items], np.int64)
        windows = -(-int(length.sum()) // capacity)
        where = differencing(length, windows)
        held: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
        for k in np.argsort(length, kind="stable"):  # the longest come last, where the capacity cuts
            held[where[k]].append(items[k])
        items = []
        for window in held:
            fill, kept = 0, []
            for i, first, size in window:
                fits = min(size, capacity - fill)
                if fits:
                    kept.append((i, first, fits))
                if fits < size:
                    items.append((i, first + fits, size - fits))
                fill += fits
            if kept:
                out.append(kept)
    return out


def _pieces(docs: DataFrame, size: int, id_col: str, text_col: str, tokenizer: str, path: str | None, with_ids: bool) -> DataFrame:
    """A row per full window of a document and one for the rest, which has its ids."""
    kind = docs.schema[id_col].dataType
    longs = ["start", "length", "crc", "doc_tokens", "task", "repeat"]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in longs], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, path), np.asarray([END_ID], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                row = hash((key, n, zlib.crc32(ids)))
                repeat = seen[row]
                seen[row] += 1
                for a in range(0, n, size):
                    part = ids[4 * a : 4 * (a + size)]
                    rows.append((key, a, len(part) // 4, zlib.crc32(part), n, task, repeat, part if with_ids or n - a < size else None))
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [batch.schema.types[0], *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", *longs, "ids"])
        enc.rest()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack_windows(
    docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", path: str | None = None, group_pieces: int = 4096, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids as binary.

    A document is its token ids and END_ID; null text is empty, so every document has at least one token, in one piece at least. Null and
    repeated ids and repeated rows are packed like any other rows. Other columns are ignored; an empty table gives an empty result.
    Sequence ids are unique, without further meaning.
    """
    pieces = _pieces(docs, size, id_col, text_col, tokenizer, path, with_ids)
    groups = -(-docs.count() // group_pieces) or 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "start", "crc", "task", "repeat"), F.lit(groups)).cast("int")).drop("task", "repeat")
    longs = ["start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in longs], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("crc", "start", "length", "id")]).combine_chunks()
        length = rows["length"].to_numpy()
        whole, rest = np.flatnonzero(length == size), np.flatnonzero(length < size)
        base = rows["group"][0].as_py() << 32
        out = [(r, 0, size, base + w, 0) for w, r in enumerate(whole)]
        for w, window in enumerate(fill_windows(length[rest], size), len(whole)):
            offset = 0
            for i, first, part in window:
                out.append((rest[i], first, part, base + w, offset))
                offset += part
        row, first, part, sequence, offset = np.asarray(out, np.int64).reshape(-1, 5).T
        ids, crc, blobs = rows["ids"], rows["crc"].to_numpy()[row], []
        for k in np.flatnonzero(part != length[row]):
            crc[k] = zlib.crc32(ids[int(row[k])].as_buffer()[4 * int(first[k]) : 4 * int(first[k] + part[k])])
        columns = {"id": rows["id"].take(pa.array(row)), "start": rows["start"].to_numpy()[row] + first, "length": part, "crc": crc, "doc_tokens": rows["doc_tokens"].to_numpy()[row], "sequence_id": sequence, "offset": offset}
        if with_ids:
            blobs = [ids[int(r)].as_buffer()[4 * int(a) : 4 * int(a + b)].to_pybytes() for r, a, b in zip(row, first, part)]
            columns["ids"] = pa.array(blobs, pa.binary())
        made = pa.table(columns)
        tidy()
        return made

    return dealt.groupBy("group").applyInArrow(pack, schema).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})


def op13_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_windows over all documents; nulls, repeats, empty tables and extra columns as there."""
    return pack_windows(table(spark, sf_dir, "documents"))
