"""Packing of token sequences by swap-based local search.

Documents are tokenised where they lie; only piece lengths and checksums travel. Full pieces are sequences by themselves.
The others are dealt by hash into groups of about `group_pieces`, and each group is packed on its own, which costs
less than one sequence a group. Every piece begins in a bin of its own; all packing is the search's. Rounds go over the underfull
bins, fullest first, and each takes what fills it most: an item by a move, or one in exchange for a smaller one of its own. When such
a round changes nothing, the bins give instead, emptiest first: an item by a move, by exchange for a smaller one, or two for one.
Every step raises the sum of squared fills, and bins run empty. It ends when the count meets the lower bound or no bin has a step left.

Bins are indexed by room, the items of underfull bins by size and what else their bin holds, and by reach, the greatest size that could
take the item's place, and size. All are numbers up to the capacity, so finding a fit is a few bit scans, however many bins there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, table
from .tokens import encoder

END_ID = 2


def tokenise_pieces(docs: DataFrame, size: int, id_col: str, text_col: str, tokenizer: str, path: str | None, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType
    longs = ["piece", "start", "length", "crc", "task", "repeat"]  # the last two tell repeated rows apart, in whatever order they come
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in longs], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, path), np.asarray([END_ID], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at = n % size or size if n > size else n
                row = hash((key, n, zlib.crc32(ids)))
                repeat = seen[row]
                seen[row] += 1
                cuts = [0, *range(at, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((key, k, a, b - a, zlib.crc32(part), task, repeat, *([part] if with_ids else [])))
            columns = list(zip(*rows)) if rows else [[]] * (7 + with_ids)
            names = ["id", *longs, *(["ids"] if with_ids else [])]
            types = [batch.schema.types[0], *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        enc.rest()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class _Slots:
    """Sets of numbers by a key from 0 to capacity, with a bit for every key in use."""

    def __init__(self):
        self.at: dict[int, set[int]] = {}
        self.used = 0

    def add(self, key: int, x: int) -> None:
        self.at.setdefault(key, set()).add(x)
        self.used |= 1 << key

    def remove(self, key: int, x: int) -> None:
        self.at[key].remove(x)
        if not self.at[key]:
            del self.at[key]
            self.used &= ~(1 << key)

    def least(self, key: int) -> int:
        """The least key in use from the given one on, or -1."""
        found = self.used >> key
        return key + (found & -found).bit_length() - 1 if found else -1

    def greatest(self, key: int) -> int:
        """The greatest key in use up to the given one, or -1."""
        return (self.used & (1 << key + 1) - 1).bit_length() - 1


class _Items:
    """Items by two keys."""

    def __init__(self):
        self.by: dict[int, _Slots] = {}
        self.keys = _Slots()

    def add(self, first: int, second: int, i: int) -> None:
        self.keys.add(first, i)
        self.by.setdefault(first, _Slots()).add(second, i)

    def remove(self, first: int, second: int, i: int) -> None:
        self.keys.remove(first, i)
        self.by[first].remove(second, i)


class LocalSearch:
    """Bins of items, improved in place. The indexes hold underfull bins and their items only."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.members = [set(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.place = {i: b for b, items in enumerate(bins) for i in items}
        self.room, self.by_size, self.by_reach = _Slots(), _Items(), _Items()
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        fill, space = self.fill[b], self.capacity - self.fill[b]
        if space and self.members[b]:
            self.room.add(space, b)
            for i in self.members[b]:
                size = self.sizes[i]
                self.by_size.add(size, fill - size, i)
                self.by_reach.add(space + size, size, i)

    def _leave(self, b: int) -> None:
        fill, space = self.fill[b], self.capacity - self.fill[b]
        if space and self.members[b]:
            self.room.remove(space, b)
            for i in self.members[b]:
                size = self.sizes[i]
                self.by_size.remove(size, fill - size, i)
                self.by_reach.remove(space + size, size, i)

    def _exchange(self, a: int, give: tuple[int, ...], b: int, take: tuple[int, ...]) -> None:
        """give goes from a to b, take from b to a."""
        self._leave(a)
        self._leave(b)
        for x, y, items in ((a, b, give), (b, a, take)):
            for i in items:
                self.members[x].remove(i)
                self.members[y].add(i)
                self.fill[x] -= self.sizes[i]
                self.fill[y] += self.sizes[i]
                self.place[i] = y
        self._enter(a)
        self._enter(b)

    def _host(self, total: int, mine: int) -> int | None:
        """An item of another bin, at least as full as mine, that is smaller than total and whose place total can take, by the tightest fit."""
        space = self.capacity - self.fill[mine]
        reach = self.by_reach.keys.least(total)
        while 0 <= reach < total + space:  # the bin's room is reach less the item's size, and at most space
            slots = self.by_reach.by[reach]
            size = slots.least(max(0, reach - space))
            while 0 <= size < total:
                if (j := next((j for j in slots.at[size] if self.place[j] != mine), None)) is not None:
                    return j
                size = slots.least(size + 1)
            reach = self.by_reach.keys.least(reach + 1)
        return None

    def take(self, b: int) -> bool:
        """The move or exchange of one item for a smaller one that fills bin b most, from a bin that it makes emptier than b was."""
        space, gain, best = self.capacity - self.fill[b], 0, None
        for own, j in sorted([(0, -1), *{self.sizes[j]: j for j in self.members[b]}.items()]):
            rest = self.fill[b] - own  # the other bin keeps less than that
            size = self.by_size.keys.greatest(own + space) if rest else -1
            while size - own > gain:
                slots = self.by_size.by[size]
                other = slots.least(0)
                while 0 <= other < rest:
                    if (i := next((i for i in slots.at[other] if self.place[i] != b), None)) is not None:
                        gain, best = size - own, (i, j)
                        break
                    other = slots.least(other + 1)
                else:
                    size = self.by_size.keys.greatest(size - 1)
                    continue
                break
        if best is not None:
            self._exchange(self.place[best[0]], best[:1], b, () if best[1] < 0 else best[1:])
        return best is not None

    def give(self, a: int) -> bool:
        """A move, an exchange of one item or of two for a smaller one, that makes bin a emptier and another, at least as full, fuller."""
        sizes, fill = self.sizes, self.fill
        items = sorted(self.members[a], key=lambda i: (-sizes[i], i))
        for i in items:
            space = self.room.least(sizes[i])
            while space >= 0:
                if (b := next((b for b in self.room.at[space] if b != a), None)) is not None:
                    if fill[b] + sizes[i] > fill[a]:
                        self._exchange(a, (i,), b, ())
                        return True
                    break  # bins with more room are emptier still
                space = self.room.least(space + 1)
        tried = set()
        for bundle in [*((i,) for i in items), *combinations(items, 2)]:
            total = sum(sizes[i] for i in bundle)
            if total <= self.capacity and total not in tried:
                tried.add(total)
                if (j := self._host(total, a)) is not None:
                    self._exchange(a, bundle, self.place[j], (j,))
                    return True
        return False

    def run(self) -> list[list[int]]:
        least, rounds = -(-sum(self.fill) // self.capacity), ((self.take, -1), (self.give, 1))
        quiet = 0
        while quiet < 2 and sum(map(bool, self.members)) > least:
            step, order = rounds[quiet]
            moved = False
            for b in sorted((b for b, items in enumerate(self.members) if items and self.fill[b] < self.capacity), key=lambda b: (order * self.fill[b], b)):
                while self.members[b] and self.fill[b] < self.capacity and step(b):
                    moved = True
            quiet = 0 if moved else quiet + 1
        return [sorted(m) for m in self.members if m]


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    return LocalSearch(sizes, bins, capacity).run()


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(sizes, [[i] for i in range(len(sizes))], capacity)


def pack_documents(
    docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", path: str | None = None, group_pieces: int = 16_384, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, the ids as binary.

    A document is its token ids and END_ID; null text is empty, so every document has at least one token. Longer ones than
    `size` are cut, the first piece taking the remainder. Null and repeated ids are packed like any other rows. Other
    columns are ignored; an empty table gives an empty result. Sequence ids are unique, without further meaning.
    """
    pieces, _ = scratch(tokenise_pieces(docs, size, id_col, text_col, tokenizer, path, with_ids))
    partial = pieces.where(F.col("length") < size)
    groups = -(-partial.count() // group_pieces) or 1
    full = pieces.drop("task", "repeat").where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = partial.withColumn("group", F.pmod(F.xxhash64("id", "piece", "length", "crc", "task", "repeat"), F.lit(groups))).drop("task", "repeat")
    schema = T.StructType([*pieces.drop("task", "repeat").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="group").sort_values(["crc", "length", "start"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, items in enumerate(pack_group(sizes, size)):
            sequence[items] = (int(key[0]) << 32) + n
            offset[items] = np.cumsum([0, *[sizes[i] for i in items[:-1]]])
        return rows.assign(sequence_id=sequence, offset=offset)

    packed = full.unionByName(partial.groupBy("group").applyInPandas(pack, schema))
    return packed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *(["ids"] if with_ids else []))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents over all documents; nulls, repeats, empty tables and extra columns as there."""
    return pack_documents(table(spark, sf_dir, "documents"))
