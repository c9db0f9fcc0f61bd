"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, and each decision has a node in the trees of the last 0 to DEPTH bytes. A node's
Krichevsky-Trofimov estimate is mixed with those below it by the weights the method gives them after all training
texts, so the probability of a byte mixes all depths.

Counts of byte contexts and of words are gathered from all training texts, packed per map batch, and stay spread over key ranges: they
grow with the corpus and are never broadcast. The batches' counts are added in rounds of at most FAN_IN a task, so that a context that
every batch has is no hot key. Contexts that only other texts have take part with a count of 0, and the value of every context is
worked out once, where its subtree of three bytes lies. Only the nodes of depth 0 to 2 are shared, at most 65,793 contexts of 255
nodes whatever the corpus, of which texts have few. The values are then dealt anew by a hash of the whole context, so that common
subtrees spread evenly, and each chunk of texts asks for those of its distinct contexts and words. Ranges are bounded in number, and beyond
what they hold the requests of a range are split by chunk, its values being sent to each part.

A text ends with the byte 255, which no UTF-8 text has. Values travel in 32 bits, sums are in 64.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import into_chunks, tiles_for, total_bytes
from .shared import scratch, table, text_or_empty, tidy
from .shingles import mix, runs_hashed
from .toxicity import held_out

DEPTH, SHARED_DEPTH = 5, 2
WORDS, CONTEXTS = 0, 1
#: The end of a text, which counts as a token.
END_KEY = np.uint64(0xE4D0FE4D0FE4D0FE)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = 255
_IN_WORD = np.asarray([not (b == 0x20 or 0x09 <= b <= 0x0D or b == END) for b in range(256)])
BATCH_BYTES, FAN_IN = 8 << 20, 256


class Texts:
    """Lower-cased bytes of some texts, DEPTH times END after each, the first of which is the text's end symbol."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
        gap = bytes([END]) * DEPTH
        self.lengths = np.asarray([len(t) for t in raw], np.int64)
        self.data = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
        self.starts = DEPTH + np.concatenate([[0], np.cumsum(self.lengths + DEPTH)[:-1]]).astype(np.int64)

    def context_keys(self, a: int, b: int) -> np.ndarray:
        """Keys of all symbols of texts a .. b-1, ends included: the bytes before, the last one first, then the symbol."""
        if a == b:
            return np.empty(0, np.uint64)
        lo, hi = int(self.starts[a]), int(self.starts[b - 1] + self.lengths[b - 1] + 1)
        # Eight bytes from DEPTH before each symbol on, little-endian: the last byte before it is the most significant of DEPTH.
        key = np.ndarray(hi - lo, "<u8", np.append(self.data[lo - DEPTH : hi + 8 - DEPTH], np.zeros(8, np.uint8)), 0, (1,)).copy()
        key &= np.uint64((1 << 8 * DEPTH) - 1)
        key <<= np.uint64(8)
        key |= self.data[lo:hi]
        keep = np.ones(hi - lo, bool)
        ends = self.starts[a : b - 1] + self.lengths[a : b - 1] - lo
        for g in range(1, DEPTH):
            keep[ends + g] = False
        return key[keep]

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and key of every word, in order; ends are left to the caller."""
        at, keys = runs_hashed(self.data, _IN_WORD[self.data])
        return np.searchsorted(self.starts, at, "right") - 1, keys


def subtree(keys: np.ndarray) -> np.ndarray:
    """A hash of contexts' last three bytes."""
    return mix(keys >> np.uint64(8 * (DEPTH - 2)))


def split_by_range(names: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts 64-bit hashes by range, and the cuts between ranges."""
    where = ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(where.astype(np.uint16) if ranges <= 1 << 16 else where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(ranges + 1))


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes, those of the same place together, which compresses well."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed), dtype=np.uint64)


def packed_rows(number: int, kind: int, keys: np.ndarray, names: np.ndarray, values: np.ndarray | None, ranges: int) -> list[tuple]:
    """keys: ascending. values: their counts, or floats."""
    order, cuts = split_by_range(names, ranges)
    keys = keys[order]
    pack = (lambda x: b"") if values is None else planes if values.dtype.kind == "i" else lambda x: x.tobytes()
    values = keys if values is None else values[order]
    return [(kind, r, number, pack_keys(keys[a:b]), pack(values[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def by_key(kind: int, keys: np.ndarray) -> np.ndarray:
    return keys if kind == WORDS else mix(keys)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "range", *names])


PART, KNOWN = ("part", "keys", "counts"), ("part", "keys", "values")


def distinct_contexts(texts: Texts) -> np.ndarray:
    return np.unique(texts.context_keys(0, len(texts.lengths)))


def gather_counts(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """(kind, range, keys, counts, distinct, total) over docs(text, train): words of training texts, and contexts of all texts
    with their number in training texts."""
    parts = -(-size // (BATCH_BYTES * FAN_IN)) or 1

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[str], other: list[str]) -> pa.Table:
            number = zlib.crc32(f"{TaskContext.get().partitionId()} {next(numbers)}".encode()) % parts
            texts, n = Texts(held + other), len(held)
            owner, words = texts.word_keys()
            words, seen = np.unique(np.concatenate([words[owner < n], np.full(n, END_KEY)]), return_counts=True)
            keys, counts = np.unique(texts.context_keys(0, n), return_counts=True)
            rest = np.setdiff1d(texts.context_keys(n, n + len(other)), keys)
            keys, counts = np.concatenate([keys, rest]), np.concatenate([counts, np.zeros(len(rest), np.int64)])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            return _table([*packed_rows(number, WORDS, words, words, seen, ranges), *packed_rows(number, CONTEXTS, keys, subtree(keys), counts, ranges)], PART)

        numbers, held, size = itertools.count(), ([], []), 0
        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[not train].append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield from rows(*held).to_batches()
                    held, size = ([], []), 0
        if held[0] or held[1]:
            yield from rows(*held).to_batches()
        tidy()

    def add(rows: pa.Table) -> pa.Table:
        keys, at = np.unique(np.concatenate([unpack_keys(x.as_py()) for x in rows["keys"]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([from_planes(x.as_py()) for x in rows["counts"]]), len(keys)).astype(np.int64)
        one = {c: rows[c][:1] for c in ("kind", "range", "part")} | {"keys": pa.array([pack_keys(keys)], pa.binary()), "counts": pa.array([planes(counts)], pa.binary())}
        tidy()
        return pa.table(one | {"distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    found = docs.select("text", "train").mapInArrow(report, "kind int, range int, part int, keys binary, counts binary")
    while True:
        found = found.groupBy("kind", "range", "part").applyInArrow(add, "kind int, range int, part int, keys binary, counts binary, distinct long, total long")
        if parts == 1:
            return found.drop("part")
        parts = -(-parts // FAN_IN)
        found = found.select("kind", "range", F.expr(f"part % {parts}").alias("part"), "keys", "counts")


_SMALL = 1 << 16
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL) - 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL, dtype=np.float64)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives so many zeros and ones, in any order."""
    half = lambda n: np.where(n < _SMALL, _HALVES[np.minimum(n, _SMALL - 1)], _stirling(n + 0.5) - 0.5 * np.log(np.pi))
    total = zeros + ones
    return half(zeros) + half(ones) - np.where(total < _SMALL, _WHOLES[np.minimum(total, _SMALL - 1)], _stirling(total + 1.0))


class Level:
    """Nodes of one depth: sorted keys (context << 8 | bits so far after a leading 1), zeros, ones and log weighted probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: sums of the children's log weighted probabilities; None at the greatest depth."""
        self.keys, own = keys, log_kt(zeros, ones)
        self.p_one = (ones + 0.5) / (zeros + ones + 1)
        self.log_w = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.log_w)

    def mixed(self, nodes: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of a one at nodes, given that of the next depth. Nodes without counts give one half."""
        if not len(self.keys):
            return np.full(len(nodes), 0.5)
        at = np.minimum(np.searchsorted(self.keys, nodes), len(self.keys) - 1)
        seen = self.keys[at] == nodes
        p = self.p_one[at] if deeper is None else self.stop[at] * self.p_one[at] + (1 - self.stop[at]) * deeper
        return np.where(seen, p, 0.5)


def _decisions(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Node at the given depth and bit of the eight decisions of each key, by key."""
    symbol, context = keys & np.uint64(255), keys >> np.uint64(8 * (DEPTH - depth + 1))
    i = np.arange(8, dtype=np.uint64)
    prefix = (np.uint64(1) << i) | (symbol[:, None] >> (np.uint64(8) - i))
    return ((context[:, None] << np.uint64(8)) | prefix).ravel(), ((symbol[:, None] >> (np.uint64(7) - i)) & np.uint64(1)).ravel().astype(bool)


def parents(nodes: np.ndarray) -> np.ndarray:
    return ((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255))


def local_levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """Levels DEPTH down to SHARED_DEPTH + 1 from the counts of distinct keys."""
    levels: dict[int, Level] = {}
    keys, counts = keys[counts > 0], counts[counts > 0]
    for depth in range(DEPTH, SHARED_DEPTH, -1):
        nodes, bits = _decisions(keys, depth)
        names, at = np.unique(nodes, return_inverse=True)
        each = np.repeat(counts, 8)
        zeros, ones = (np.bincount(at, each * (bits == b), len(names)).astype(np.int64) for b in (False, True))
        levels[depth] = Level(names, zeros, ones, below(levels[depth + 1], names) if depth < DEPTH else None)
        levels[depth].zeros, levels[depth].ones = zeros, ones
    return levels


def below(children: Level, names: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(names, parents(children.keys)), children.log_w, len(names))


def shared_levels(counts: DataFrame) -> dict[int, Level]:
    """Levels SHARED_DEPTH down to 0, from the roots that each range has of the next depth."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                top = local_levels(unpack_keys(keys.as_py()), from_planes(n.as_py()).astype(np.int64))[SHARED_DEPTH + 1]
                yield pa.RecordBatch.from_arrays([pa.array(parents(top.keys).astype(np.int64)), pa.array(top.zeros), pa.array(top.ones), pa.array(top.log_w)], names=["node", "zeros", "ones", "log_w"])

    nodes = counts.where(F.col("kind") == CONTEXTS).select("keys", "counts").mapInArrow(roots, "node long, zeros long, ones long, log_w double")
    top = nodes.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w")).orderBy("node").toPandas()
    names, zeros, ones, sums = top["node"].to_numpy(np.int64).astype(np.uint64), top["zeros"].to_numpy(np.int64), top["ones"].to_numpy(np.int64), top["log_w"].to_numpy(np.float64)
    levels = {SHARED_DEPTH: Level(names, zeros, ones, sums)}
    for depth in range(SHARED_DEPTH - 1, -1, -1):
        upper, at = np.unique(parents(names), return_inverse=True)
        zeros, ones = (np.bincount(at, x, len(upper)).astype(np.int64) for x in (zeros, ones))
        levels[depth] = Level(upper, zeros, ones, np.bincount(at, levels[depth + 1].log_w, len(upper)))
        names = upper
    return levels


def symbol_scores(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, shared: dict[int, Level]) -> np.ndarray:
    """log10 probability of each wanted key's symbol in its context."""
    levels = shared | local_levels(keys, counts) if len(keys) else shared
    p = None
    for depth in range(DEPTH, -1, -1):
        nodes, bits = _decisions(wanted, depth)
        p = levels[depth].mixed(nodes, p) if depth in levels else np.full(len(nodes), 0.5)
    return np.log10(np.where(bits, p, 1 - p)).reshape(-1, 8).sum(1)


def known_values(counts: DataFrame, shared, ranges: int) -> DataFrame:
    """(kind, range, part, keys, values): log10 of word counts plus 0.1 and of context probabilities, dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = unpack_keys(keys), from_planes(n).astype(np.int64)
                values = np.log10(n + 0.1) if kind == WORDS else symbol_scores(keys, keys, n, shared.value)
                yield from _table(packed_rows(0, kind, keys, by_key(kind, keys), values.astype(DTYPES[kind]), ranges), KNOWN).to_batches()
            tidy()

    return counts.select("kind", "keys", "counts").mapInArrow(run, "kind int, range int, part int, keys binary, values binary")


#: Of values, by kind.
DTYPES = ("<f8", "<f4")


def score_texts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Per row of docs(id, text, train): id, n_tokens, n_known, word_score (sum of log10(c + 0.1)) and score; further the number of
    training tokens and of distinct ones. Without null texts."""
    _, size = total_bytes(docs)
    ranges, parts = tiles_for(docs, size)
    counts, _ = scratch(gather_counts(docs, size, ranges))
    n, v = counts.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    shared = docs.sparkSession.sparkContext.broadcast(shared_levels(counts))
    known = known_values(counts, shared, ranges)
    if parts > 1:
        known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    chunks = into_chunks(docs.select("id", "text"), size)

    def ask(part: pa.Table) -> pa.Table:
        texts = Texts(part["text"].to_pylist())
        words, contexts = np.unique(np.append(texts.word_keys()[1], END_KEY)), distinct_contexts(texts)
        chunk = part["chunk"][0].as_py()
        out = _table([*packed_rows(chunk, WORDS, words, words, None, ranges), *packed_rows(chunk, CONTEXTS, contexts, mix(contexts), None, ranges)], ("chunk", "keys", "counts"))
        tidy()
        return out.drop_columns("counts").append_column("part", pa.array(np.full(len(out), chunk % parts, np.int32)))

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "range": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        kind = asked["kind"][0].as_py()
        keys = np.concatenate([np.empty(0, np.uint64), *(unpack_keys(x.as_py()) for x in known["keys"])])
        values = np.concatenate([np.empty(0, DTYPES[kind]), *(np.frombuffer(x.as_py(), DTYPES[kind]) for x in known["values"])])
        order = np.argsort(keys)
        keys, values, blobs = keys[order], values[order], []
        for x in asked["keys"]:
            wanted = unpack_keys(x.as_py())
            if kind == CONTEXTS:  # all of them are known
                found = values[np.searchsorted(keys, wanted)]
            elif len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = np.where(keys[at] == wanted, values[at], -1.0)
            else:
                found = np.full(len(wanted), -1.0)
            blobs.append(found.astype(DTYPES[kind]).tobytes())
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "range": asked["range"], "values": pa.array(blobs, pa.binary())})

    def settle(part: pa.Table, replies: pa.Table) -> pa.Table:
        texts = Texts(part["text"].to_pylist())
        owner, words = texts.word_keys()
        word_at, word_keys = pd.factorize(np.append(words, END_KEY))
        at, contexts = pd.factorize(texts.context_keys(0, len(part)))
        found = []
        for kind, keys in ((WORDS, word_keys), (CONTEXTS, contexts)):
            own = replies.take(np.flatnonzero(replies["kind"].to_numpy() == kind))
            rank = np.argsort(own["range"].to_numpy(), kind="stable")
            blobs, ascending = own["values"].to_pylist(), np.argsort(keys)
            order, _ = split_by_range(by_key(kind, keys[ascending]), ranges)
            values = np.empty(len(keys), np.float64)
            values[ascending[order]] = np.concatenate([np.frombuffer(blobs[i], DTYPES[kind]) for i in rank])
            found.append(values)
        docs_n, logs = len(part), found[0][word_at]
        logs, end = logs[:-1], logs[-1]
        n_tokens = np.bincount(owner, minlength=docs_n) + 1
        n_known = np.bincount(owner, logs > -0.99, docs_n).astype(np.int64) + int(end > -0.99)
        score = np.add.reduceat(found[1][at], np.concatenate([[0], np.cumsum(texts.lengths[:-1] + 1)]).astype(np.int64))
        columns = [part["id"].combine_chunks(), pa.array(n_tokens), pa.array(n_known), pa.array(np.bincount(owner, logs, docs_n) + end), pa.array(score)]
        tidy()
        return pa.Table.from_arrays(columns, names=["id", "n_tokens", "n_known", "word_score", "score"])

    out = T.StructType([docs.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("word_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    asked = chunks.groupBy("chunk").applyInArrow(ask, "kind int, range int, chunk int, keys binary, part int")
    replies = asked.groupBy("kind", "range", "part").cogroup(known.groupBy("kind", "range", "part")).applyInArrow(reply, "chunk int, kind int, range int, values binary")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, out), n, v


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and code_length_bits.

    Rows whose crc32(id as text) is divisible by folds are held out of training; null ids aren't. A null text is empty: one token, its end. The
    score is the log10 probability of the text's bytes, A-Z in lower case, and its end. Without training rows every bit is even
    odds. Repeated rows train repeatedly and get equal scores. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    scored, n, v = score_texts(rows.withColumn("train", ~held_out("id", folds)))
    base = F.col("word_score") - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))
    bits = F.col("score") / -F.log10(F.lit(2.0))
    return scored.select(F.col("id").alias(id_col), held_out("id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("code_length_bits"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language_scores over all documents; nulls, repeats, empty tables and extra columns as there."""
    return language_scores(table(spark, sf_dir, "documents"))
