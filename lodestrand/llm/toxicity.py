"""Toxicity by the nearest labelled examples.

Terms are lower-cased words. A bounded sample of labelled rows gives the examples; their
vectors are over all their terms, with document frequencies from all documents, and terms that go with the label weigh
`lift_weight` times as much. Examples lie in an inverted index whose postings are cut into blocks of BLOCK examples with the
greatest weight of each. Terms that more than one in DENSE examples have prune nothing; their rows of the index are full vectors, and
their part of all cosines is taken for many queries at once. A query bounds every block by the greatest such part and the
maxima of its other terms, and opens only blocks whose bound reaches the k-th greatest such part, which no k-th best cosine is
below, so its neighbours are exact. Terms that no example has are left out of a query's
vector: they don't change which examples are nearest. Examples with a cosine of 1 vote alone.
Votes are weighted by closeness and by how thinly the example's class was sampled, then mapped to frequencies seen when each
example is scored by the others. All bounds are parameters: the index doesn't grow with the corpus, and is broadcast.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, table, tidy

WORD = re.compile(r"\w+")
BLOCK, CACHE, RANGE, DENSE, QUERIES, SLICE = 64, 50_000, 4096, 24, 64, 512


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Features(dict):
    """Word to its term's number, -1 if it isn't one, for up to CACHE words at a time."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        found = self.vocabulary.get(word, -1)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 48:
            self[word] = found
        return found


def term_counts(text: str, features: _Features) -> np.ndarray:
    """Sorted (term number, occurrences) of the whole text, a row each."""
    words = words_of(text)
    found = np.sort(np.fromiter(map(features.__getitem__, words), np.int32, len(words)))
    found = found[np.searchsorted(found, 0) :]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
    return np.stack([found[starts], np.diff(np.append(starts, len(found)))], axis=1).astype(np.int32)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from every start on, as many as its length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class NeighbourIndex:
    """Exact cosine neighbours among examples, given as term counts with label, class weight and id."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    examples: list[tuple[Iterable[tuple[int, int]], int, float, object]]
    k: int = 25
    knots: tuple[np.ndarray, np.ndarray] | None = None
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        # Examples with the same rarest term lie together, which keeps block maxima telling.
        self.examples = [(np.asarray(c, np.int32).reshape(-1, 2), *rest) for c, *rest in self.examples]
        rare = lambda counts: int(counts[self.idf[counts[:, 0]].argmax(), 0])
        blank = [x for x in self.examples if not len(x[0])]
        mass = [sum(w for _, y, w, _ in blank if y == c) for c in (0, 1)]
        every = [sum(w for _, y, w, _ in self.examples if y == c) for c in (0, 1)]
        prior = every[1] / sum(every) if sum(every) else 0.5
        self.blank_score = (mass[1] + prior) / (sum(mass) + 1)
        self.examples = sorted((x for x in self.examples if len(x[0])), key=lambda x: (rare(x[0]), x[0].tobytes(), x[1], str(x[3])))
        self.n = n = len(self.examples)
        self.blocks = -(-n // BLOCK)
        sizes = [len(x[0]) for x in self.examples]
        vectors = [self.vector(x[0]) for x in self.examples]
        term = np.concatenate([np.empty(0, np.int32), *(t for t, _ in vectors)])
        weight, where = np.concatenate([np.empty(0), *(w for _, w in vectors)]), np.repeat(np.arange(n, dtype=np.int32), sizes)
        held = np.bincount(term, minlength=len(self.idf))
        common = np.argsort(-held, kind="stable")[:1024]
        common = np.sort(common[held[common] > n / DENSE])
        self.column = np.full(len(self.idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense, full = np.zeros((len(common), n)), self.column[term] >= 0
        self.dense[self.column[term[full]], where[full]] = weight[full]
        order = np.argsort(np.where(full, -1, term), kind="stable")[full.sum() :]
        term, self.where, self.weight = term[order], where[order].astype(np.intp), weight[order]
        # An entry for every term and block that has it: where its postings start, and their greatest weight.
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.where[1:] // BLOCK != self.where[:-1] // BLOCK)
        self.opens = np.arange(0, n, BLOCK)
        starts = np.flatnonzero(new)
        self.post = np.append(starts, len(term))
        self.block = self.where[starts] // BLOCK
        self.block_max = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        self.first = np.searchsorted(term[starts], np.arange(len(self.idf) + 1))
        self.label = np.asarray([x[1] for x in self.examples], np.float64)
        self.share = np.asarray([x[2] for x in self.examples], np.float64)
        self.ids = [x[3] for x in self.examples]
        if self.knots is None and n:
            self._calibrate()

    def __getstate__(self) -> bytes:
        """Packed, and without the postings, which whoever reads it builds again: executors keep broadcasts on disk."""
        pairs = np.concatenate([np.empty((0, 2), np.int32), *(x[0] for x in self.examples)]).T
        rest = [(len(c), *x) for c, *x in self.examples]
        return zlib.compress(pickle.dumps((self.vocabulary, self.idf, np.ascontiguousarray(pairs), rest, self.k, self.knots, self.blank_score)), 1)

    def __setstate__(self, state: bytes) -> None:
        self.vocabulary, self.idf, pairs, rest, self.k, self.knots, blank_score = pickle.loads(zlib.decompress(state))
        parts = np.split(pairs.T, np.cumsum([x[0] for x in rest])[:-1]) if rest else []
        self.examples = [(c, *x[1:]) for c, x in zip(parts, rest, strict=True)]
        self.memo = {}
        self.__post_init__()
        self.blank_score = blank_score  # examples without a term are gone by now
        self.examples = []  # their postings are all that queries need
        tidy()

    def vector(self, counts: Iterable[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.asarray(counts, np.int32).reshape(-1, 2)
        w = (1 + np.log(counts[:, 1])) * self.idf[counts[:, 0]]
        return counts[:, 0], w / math.sqrt((w * w).sum()) if len(w) else w

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the cosines of some queries with all examples: what common terms contribute."""
        part = np.zeros((len(vectors), len(self.dense)))
        for row, (terms, weights) in zip(part, vectors, strict=True):
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return part @ self.dense

    def nearest(self, counts: Iterable[tuple[int, int]], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with any cosine above 0; equals by number."""
        vector = self.vector(counts)
        return self._nearest(vector, self.common_part([vector])[0], k, without)

    def _nearest(self, vector: tuple[np.ndarray, np.ndarray], base: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """base: the query's common part. No cosine is less, so its k-th greatest is the first threshold that blocks must reach."""
        fs, q = vector
        rare = self.column[fs] < 0
        fs, q = fs[rare], q[rare]
        has = self.first[fs + 1] - self.first[fs]
        entry, part = _ranges(self.first[fs], has), np.repeat(q, has)
        block = self.block[entry]
        bound = np.bincount(block, part * self.block_max[entry], self.blocks) + np.maximum.reduceat(base, self.opens)
        k_all = k + (without >= 0)
        kth = np.partition(base, -k_all)[-k_all] if len(base) > k_all else 0.0
        opened = (bound > 0) & (bound >= kth - 1e-12)
        here = opened[block]
        entry, part = entry[here], part[here]
        lengths = self.post[entry + 1] - self.post[entry]
        at = _ranges(self.post[entry], lengths)
        scores = base + np.bincount(self.where[at], np.repeat(part, lengths) * self.weight[at], len(base))
        ids = np.flatnonzero((scores > 0) & (scores >= kth - 1e-11) & np.repeat(opened, BLOCK)[: len(base)])
        ids = ids[ids != without]
        if len(ids) > k:
            sims = scores[ids]
            ids = ids[sims >= np.partition(sims, -k)[-k] - 1e-11]
        best = ids[np.lexsort((ids, -np.round(scores[ids], 12)))][:k]
        return best, scores[best]

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """The label's share among neighbours, weighted by closeness; the less close all are, the nearer to blank_score.
        Examples with a cosine of 1 decide alone, so that a copy of an example gets its label however many others are near."""
        if (same := sims > 1 - 1e-9).any():
            return float(np.average(self.label[ids[same]], weights=self.share[ids[same]]))
        w, blank = self.share[ids] * sims**2 / (1.05 - sims), 0.5 * self.share.mean()
        return float(((w * self.label[ids]).sum() + blank * self.blank_score) / (w.sum() + blank))

    def _calibrate(self) -> None:
        """Pool adjacent violators over leave-one-out votes."""
        raw = np.empty(len(self.examples))
        for a in range(0, len(raw), QUERIES):
            some = [self.vector(x[0]) for x in self.examples[a : a + QUERIES]]
            for e, (vector, base) in enumerate(zip(some, self.common_part(some), strict=True), a):
                raw[e] = self.vote(*self._nearest(vector, base, self.k, e))
        blocks: list[list[float]] = []
        for e in np.argsort(raw, kind="stable"):
            blocks.append([self.share[e], self.share[e] * raw[e], self.share[e] * self.label[e]])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
        self.knots = np.asarray([b[1] / b[0] for b in blocks]), np.asarray([b[2] / b[0] for b in blocks])

    def score(self, queries: list[np.ndarray]) -> list[tuple[float, float, list]]:
        """For each of some term counts: score, greatest cosine and the ids of the five nearest examples."""
        keys = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in queries]
        if not self.n:
            return [(self.blank_score, 0.0, [])] * len(queries)
        new = {k: c for k, c in zip(keys, queries, strict=True) if len(c) and k not in self.memo}
        out = {k: self.memo[k] for k in keys if k in self.memo}
        if len(self.memo) + len(new) > CACHE // 8:
            self.memo.clear()
        names = list(new)
        for a in range(0, len(names), QUERIES):
            vectors = [self.vector(new[k]) for k in names[a : a + QUERIES]]
            for key, vector, base in zip(names[a:], vectors, self.common_part(vectors)):
                ids, sims = self._nearest(vector, base, self.k)
                raw = self.vote(ids, sims)
                # A little of the raw vote stays in, so that votes within one pooled block keep their order.
                out[key] = self.memo[key] = 0.98 * float(np.interp(raw, *self.knots)) + 0.02 * raw, float(sims[0]) if len(sims) else 0.0, [self.ids[i] for i in ids[:5]]
        return [out[k] if len(c) else (self.blank_score, 0.0, []) for k, c in zip(keys, queries, strict=True)]


def document_frequencies(docs: DataFrame, text_col: str, held: Broadcast) -> np.ndarray:
    """In how many of all documents each term is. Every task sends one array a range of RANGE terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = _Features(held.value), np.zeros(len(held.value) + 1, np.int64)  # the last one counts words that aren't terms
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set(words_of(text or ""))
                seen[np.fromiter(map(features.__getitem__, words), np.int32, len(words))] += 1
        seen = seen[:-1]
        at = range(0, len(seen), RANGE)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([seen[a : a + RANGE] for a in at], pa.list_(pa.int64()))], names=["a", "seen"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in part.column(1).to_pylist()], axis=0)
        return pa.table({"a": part.column(0)[:1], "seen": pa.array([total], pa.list_(pa.int64()))})

    schema = "a int, seen array<long>"
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema).groupBy("a").applyInArrow(add, schema).collect()
    total = np.zeros(len(held.value), np.int64)
    for r in found:
        total[r["a"] : r["a"] + len(r["seen"])] = r["seen"]
    return total


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int = 6000, max_terms: int = 2048, min_lift: float = 3.0, k: int = 25, lift_weight: float = 32.0) -> NeighbourIndex:
    """An index from about max_examples documents with a label, half of each class where there are enough, chosen by a hash of the id.
    Its terms are all that the examples have. Up to max_terms that are at least min_lift times as frequent with the label as without, and
    more than chance explains, weigh lift_weight times their inverse document frequency, all others just that.

    Null labels are ignored, of several labels of one id the greatest counts, and null texts are empty. Without any rows of a class,
    the scores are that class's share. The chosen ids are broadcast: max_examples bounds them.
    """
    rows = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    rate = {y: min(1.0, max_examples / 2 / n) for y, n in sizes.items()}
    limit = F.when(F.col("y") == 1, F.lit(rate.get(1, 1.0))).otherwise(F.lit(rate.get(0, 1.0)))
    chosen_ids = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < limit * 1_000_003)
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen_ids), "id")
    sample, _ = scratch(picked.groupBy("text", "y").agg(F.min("id").alias("id")))  # else copies of one text make its every word telling
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(set(words_of(text or "")))
            for y, counts in enumerate(seen):
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[t] * (1 - y) for t in keys], pa.int64()), pa.array([counts[t] * y for t in keys], pa.int64())], names=["term", "a", "b"])

    counts = sample.select("text", "y").mapInArrow(count_terms, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = F.col("a") + F.col("b")
    part = lambda seen, share: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (both * share))).otherwise(0.0)
    gain = 2 * (part("b", F.lit(pos / (pos + neg))) + part("a", F.lit(neg / (pos + neg))))
    lift = (F.col("b") + 0.5) / pos / ((F.col("a") + 0.5) / neg)
    counts, _ = scratch(counts)
    vocabulary = {t: i for i, t in enumerate(counts.select("term").orderBy("term").toArrow().column(0).to_pylist())}
    tidy()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    often = counts.where("b >= 3")
    # Of so many terms some go with the label by chance; twice the logarithm of their number is what chance alone reaches.
    chance = 2 * math.log(max(2, often.count()))
    chosen = often.withColumn("gain", gain).where((lift >= min_lift) & (F.col("gain") >= chance)).orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    weights = {y: 1 / r for y, r in rate.items()}
    idf = 1 + np.log((1 + docs.count()) / (1 + document_frequencies(docs, text_col, held)))
    idf[[vocabulary[r["term"]] for r in chosen]] *= lift_weight

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(held.value)
        for batch in batches:
            found = [term_counts(t or "", features) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[:, 0] for x in found], pa.list_(pa.int32())), pa.array([x[:, 1] for x in found], pa.list_(pa.int32()))], names=["id", "y", "f", "c"])

    schema = T.StructType([sample.schema["id"], sample.schema["y"], T.StructField("f", T.ArrayType(T.IntegerType())), T.StructField("c", T.ArrayType(T.IntegerType()))])
    got = sample.select("id", "text", "y").mapInArrow(extract, schema).toArrow()
    pairs = (np.stack([f.values.to_numpy(), c.values.to_numpy()], axis=1) for f, c in zip(got.column("f"), got.column("c"), strict=True))
    examples = [(x, y, weights[y], i) for x, y, i in zip(pairs, got.column("y").to_pylist(), got.column("id").to_pylist(), strict=True)]
    del got, pairs
    index = NeighbourIndex(vocabulary, idf, examples, k)
    tidy()
    return index


def score_toxicity(docs: DataFrame, index: NeighbourIndex, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, score, predicted, similarity (greatest cosine), evidence (ids of the five nearest examples) and,
    with carry, the input row as struct `row`. Empty and null texts get the share of the label among examples without any
    term. Repeated rows get equal scores; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    id_type = docs.schema[id_col].dataType
    out = [docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("evidence", T.ArrayType(id_type))]
    out[0] = T.StructField("id", id_type)
    if carry:
        out.append(T.StructField("row", docs.schema, False))

    # A carried row holds id and text; sent beside it, they would double what Arrow buffers take.
    inside = carry and isinstance(docs.schema[text_col].dataType, T.StringType)
    at_id, at_text = (docs.columns.index(c) for c in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        features = _Features(index.vocabulary)
        for whole in batches:
            for a in range(0, len(whole), SLICE):
                batch = whole.slice(a, SLICE)
                row = batch.column(0) if inside else None
                ids, texts = (row.field(at_id), row.field(at_text)) if inside else (batch.column(0), batch.column(1))
                got = index.score([term_counts(t or "", features) for t in texts.to_pylist()])
                score = [min(1.0, max(0.0, g[0])) for g in got]
                arrays = [ids, pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(ids.type))]
                yield pa.RecordBatch.from_arrays([*arrays, *([row] if inside else batch.columns[2:])], names=[f.name for f in out])
        index.memo.clear()
        tidy()

    row = F.struct("*").alias("row")
    picked = docs.select(row) if inside else docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([row] if carry else []))
    return picked.mapInArrow(run, T.StructType(out)).withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> NeighbourIndex:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label_toxic")).where(~held_out("doc_id", 5))
    return fit(docs.select("doc_id", "text"), labels, "doc_id", "text", "label_toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity over all documents, fitted on the labels of rows that aren't held out; nulls, repeats, empty tables and extra
    columns as there."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_on_labels(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", "predicted", "similarity", "evidence")
