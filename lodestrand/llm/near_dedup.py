"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Each document is the weighted set of its five-word shingles: occurrences times inverse document frequency, counted over all
documents. Consistent weighted samples agree between two documents as often as their weighted Jaccard similarity says.
BANDS bands of ROWS samples make buckets. A bucket never makes all its pairs: every member is verified against the
bucket's leader, and what the leader leaves apart is compared only where an exact bound allows the similarity. Call a shingle rare
if at most RARE rows have it. Two similar texts either share one of the rare shingles among the first of each in order of rarity
(prefix filter: those before the rest falls short of the overlap that the similarity asks for), or the weight of the shingles that aren't
rare is enough by itself in both. The first kind meets by equi-join on the shingle, at most RARE texts a key; the second, by bucket and
total weight. Groups are the connected components of the verified links between distinct texts.
Copies of one text are one node throughout, and only identifiers and links are iterated over.

The inverse document frequency is 1 + IDF_SPREAD * ln((1 + N) / (1 + df)) / ln(1 + N), with df rounded to an eighth of a power
of two. The spread is kept small: the shingles that a large group of near copies has in common are frequent just because
of the group, and would count so little beside each copy's own that the group fell apart.

A bucket's leader is its member with the least share of rare shingles, then the one that meets most others over all bands. In a
group made from one original that is the original or the least changed copy, and members that are unlike it are rich in rare
shingles, which the bound above sets apart without a comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import answer, answered, into_chunks, request, tiles_for, total_bytes, with_answers
from .shared import broadcast_if_small, drop_scratch, scratch, table, text_or_empty, tidy
from .shingles import document_shingles, mix

BANDS, ROWS, IDF_SPREAD = 12, 3, 0.1


#: Shingles of at most so many rows are rare; as a code of document frequencies.
RARE = 16
RARE_CODE = 8 * int(math.log2(RARE))
#: A text's packed vector: sorted shingle hashes, occurrences and codes of document frequencies.
VECTOR = np.dtype([("hash", "<u8"), ("tf", "<u4"), ("code", "u1")])


def df_code(df: np.ndarray) -> np.ndarray:
    return np.round(8 * np.log2(df)).astype(np.uint8)


def idf(code: np.ndarray, n_docs: int) -> np.ndarray:
    return 1 + IDF_SPREAD * (np.log((1 + n_docs) / (1 + 2.0 ** (code.astype(np.float64) / 8))) / math.log(1 + n_docs)).clip(0, 1)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) by 16-bit quantile, its inverse and its logarithm: inverts 1 - (1 + x) exp(-x)."""
    x = np.geomspace(1e-4, 40, 400_000)
    gamma = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
    return gamma, (1 / gamma).astype(np.float32), np.log(gamma)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int = BANDS * ROWS, first: int = 0) -> np.ndarray:
    """samples x documents 32-bit samples, numbered from first, of the weighted sets hashes[starts[i]:starts[i + 1]], none empty."""
    gamma, inverse, log_gamma = _draws()
    out = np.empty((samples, len(starts)), np.uint32)
    log_w, base = np.log(weights).astype(np.float32), mix(hashes)
    blocks = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(hashes), 16_384)), [len(starts)]]))
    for a, b in zip(blocks, blocks[1:]):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(hashes)
        h, lw, at = base[lo:hi], log_w[lo:hi], starts[a:b] - lo
        ordered = np.empty((hi - lo, 2), np.uint32)  # name, then score: little-endian halves of a number that sorts by score
        for k in range(samples):
            x = h ^ np.uint64((first + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            parts = x.view(np.uint16).reshape(-1, 4)
            i = parts[:, 0].astype(np.intp)
            beta = parts[:, 1] * np.float32(1 / 65536)
            t = np.floor(lw * inverse.take(i) + beta)
            score = log_gamma.take(parts[:, 2].astype(np.intp)) - gamma.take(i) * (t - beta + np.float32(1))
            bits = score.view(np.int32)
            ordered[:, 1] = (bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))).view(np.uint32)
            ordered[:, 0] = x.view(np.uint32)[1::2] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[k, a:b] = np.minimum.reduceat(ordered.view(np.int64).ravel(), at).astype(np.uint32)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """documents x BANDS 64-bit keys."""
    keys = []
    for b in range(BANDS):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for row in samples[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


SKETCH = T.StructType(
    [T.StructField("text_sha256", T.StringType()), T.StructField("row_no", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())]
)


def sketch(docs: DataFrame) -> tuple[DataFrame, int]:
    """A row per row of docs(id, text): id, digest, a number of its own, band keys and df codes; and the number of rows."""
    n, size = total_bytes(docs)
    chunks, (ranges, parts) = into_chunks(docs, size), tiles_for(docs, size)
    schema = T.StructType([docs.schema["id"], *SKETCH.fields])

    def keys_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, hashes, _ = document_shingles(part["text"].to_pylist())
        return np.unique(hashes, return_counts=True)

    def use(part: pa.Table, replies: pa.Table) -> pa.Table:
        texts = part["text"].to_pylist()
        doc, hashes, tf = document_shingles(texts)
        _, at = np.unique(hashes, return_inverse=True)
        codes = answered(replies, "u1")[at]
        have, starts = np.unique(doc, return_index=True)
        bands, blobs = [None] * len(texts), [b""] * len(texts)
        if len(have):
            s = weighted_samples(hashes, tf * idf(codes, n), starts)
            keys, ends = band_keys(s), np.append(starts[1:], len(hashes))
            for i, d in enumerate(have):
                bands[d], blobs[d] = keys[i], codes[starts[i] : ends[i]].tobytes()
        first = part["chunk"][0].as_py() << 32 if len(texts) else 0
        arrays = [
            part["id"].combine_chunks(), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(range(first, first + len(texts)), pa.int64()),
            pa.array(bands, pa.list_(pa.int64())), pa.array(blobs, pa.binary()),
        ]
        return pa.Table.from_arrays(arrays, names=schema.names)

    replies = answer(request(chunks, keys_of, ranges), lambda keys, df: df_code(df), parts)
    return scratch(with_answers(chunks, replies, use, schema))[0], n


def weighted_jaccard(left: bytes, right: bytes, n_docs: int) -> float:
    """Of two vectors as vectors() packs them."""
    a, b = np.frombuffer(left, VECTOR), np.frombuffer(right, VECTOR)
    _, i, j = np.intersect1d(a["hash"], b["hash"], True, True)
    least = (np.minimum(a["tf"][i], b["tf"][j]) * idf(a["code"][i], n_docs)).sum()
    return float(least / ((a["tf"] * idf(a["code"], n_docs)).sum() + (b["tf"] * idf(b["code"], n_docs)).sum() - least))


def vectors(texts: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """(node, vector, weight, common, prefix) of texts(node, text, codes): the packed vector, its whole weight, that of shingles which
    aren't rare, and the rare ones among the rarest that together weigh more than a text as similar can miss."""
    schema = "node string, vector binary, weight double, common double, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, text, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, hashes, tf = document_shingles([text])
                packed = np.empty(len(hashes), VECTOR)
                packed["hash"], packed["tf"], packed["code"] = hashes, tf, np.frombuffer(codes, "u1")
                weights = tf * idf(packed["code"], n_docs)
                rare, total = packed["code"] <= RARE_CODE, weights.sum()
                order = np.lexsort((hashes, packed["code"]))  # the same order of shingles in all texts
                before = np.cumsum(weights[order]) - weights[order]
                first = order[before <= (1 - similarity) * total * (1 + 1e-9) + 1e-9]
                out.append((node, packed.tobytes(), total, weights[~rare].sum(), hashes[first[rare[first]]].view(np.int64)))
            kinds = [pa.string(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "vector", "weight", "common", "prefix"])
        tidy()

    return texts.select("node", "text", "codes").mapInArrow(run, schema)


def verify(pairs: DataFrame, vector: DataFrame, similarity: float, n_docs: int) -> DataFrame:
    """Those of pairs(a, b) that are similar enough, as (a, b, similarity)."""
    of = lambda name, value: vector.select(F.col("node").alias(name), F.col("vector").alias(value))
    rows = pairs.join(of("a", "va"), "a").join(of("b", "vb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.asarray([weighted_jaccard(x.as_py(), y.as_py(), n_docs) for x, y in zip(batch.column(2), batch.column(3), strict=True)], np.float64)
            table = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "similarity"])
            yield table.filter(pa.array(sims >= similarity - 1e-9))
        tidy()

    return rows.select("a", "b", "va", "vb").mapInArrow(run, "a string, b string, similarity double")


#: Total weights that differ by less than this factor share a bin.
BIN = 1.02


def unled_pairs(apart: DataFrame, bands: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of apart(band, node, label, weight, common, prefix) that share a bucket, have different labels and may be similar: all
    that are, by the argument at the top of this file. bands(node, bands) has the buckets of every node."""
    members, _ = scratch(apart.select("node", "label", "prefix").dropDuplicates(["node"]))
    posted = members.select("node", "label", F.explode("prefix").alias("shingle"))
    other = posted.withColumnsRenamed({"node": "node2", "label": "label2"})
    met = posted.join(other, "shingle").where((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2"))).select("node", "node2").distinct()
    met = met.join(bands, "node").join(bands.withColumnsRenamed({"node": "node2", "bands": "bands2"}), "node2").where(F.arrays_overlap("bands", "bands2"))

    # x and y share at least part * (weight of x + weight of y), and no more than the common weight of either.
    part = similarity / (1 + similarity)
    bin_of = lambda w: F.floor(F.log(w) / math.log(BIN))
    able = apart.select("band", "node", "label", "weight", "common").where(F.col("common") >= similarity * F.col("weight") - 1e-9)
    split = able.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    able = able.join(split, "band")
    most = F.least(F.col("weight") / similarity, F.col("common") / part - F.col("weight"))
    asking = able.withColumn("bin", F.explode(F.sequence(bin_of(similarity * F.col("weight")) - 1, bin_of(F.greatest(most, similarity * F.col("weight"))) + 1)))
    asked = able.select("band", bin_of(F.col("weight")).alias("bin"), *[F.col(c).alias(f"{c}2") for c in ("node", "label", "weight", "common")])
    allowed = F.least("common", "common2") >= part * (F.col("weight") + F.col("weight2")) - 1e-9
    plain = asking.join(asked, ["band", "bin"]).where((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & allowed)
    return met.select("node", "node2").union(plain.select("node", "node2")).distinct().toDF("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links(a, b): the least node of each connected component, by rounds of taking the least label
    around and then the label's own label."""
    spark = links.sparkSession
    edges, _ = scratch(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels, path = scratch(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = edges.join(labels.withColumnsRenamed({"node": "b", "label": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "other").alias("next"))
        jump = near.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left").select("node", "label", F.least("next", "far").alias("new"))
        jump, next_path = scratch(jump)
        changed = not jump.where("new <> label").isEmpty()
        drop_scratch(spark, path)
        labels, path = jump.select("node", F.col("new").alias("label")), next_path
        if not changed:
            return labels


def near_groups(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, class_size, kept, text_sha256.

    Rows belong to one class if their texts are linked by a chain of weighted similarities of at least `similarity`, or equal. class_id is the least id
    of the class, null ids last; exactly one row of a class is kept, of that id. Texts of one to four words are
    one shingle; texts without words, null included, are only alike if equal. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    drawn, n = sketch(rows)
    named = drawn.withColumnRenamed("text_sha256", "node")
    nodes, _ = scratch(named.where("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("codes").alias("codes")))

    spots = nodes.select("node", F.explode("bands").alias("band"))
    met, _ = scratch(spots.join(spots.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band"))
    wanted, _ = scratch(met.groupBy("node").agg(F.sum("size").alias("degree")))
    texts = rows.withColumn("node", F.sha2("text", 256)).join(broadcast_if_small(wanted.select("node")), "node")
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(nodes.select("node", "codes"), "node")
    vector, _ = scratch(vectors(texts, n, similarity))
    rank = vector.join(wanted, "node").select("node", F.struct(F.round(F.col("common") / F.col("weight"), 3), "degree", "node").alias("rank"))
    leaders = met.join(rank, "node").groupBy("band").agg(F.max("rank").getField("node").alias("leader"))
    led, _ = scratch(met.join(leaders, "band").select("band", "node", "leader"))
    pairs = led.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links, _ = scratch(verify(pairs, vector, similarity, n))
    labels, _ = scratch(components(links))

    # Members of a bucket that its leader didn't bring together.
    apart = led.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    split = apart.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    apart, _ = scratch(apart.join(split, "band").join(vector.select("node", "weight", "common", "prefix"), "node"))
    more, _ = scratch(unled_pairs(apart, nodes.select("node", "bands"), similarity))
    late, _ = scratch(verify(more.join(pairs, ["a", "b"], "left_anti"), vector, similarity, n))
    if not late.isEmpty():
        labels, _ = scratch(components(links.unionByName(late)))

    member = named.select("id", "node", "row_no").join(labels, "node", "left").select("id", "row_no", "node", F.coalesce("label", "node").alias("label"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "node", "row_no")
    heads = member.groupBy("label").agg(F.min(rank).alias("head"), F.count("*").alias("class_size"))
    kept = F.col("row_no") == F.col("head.row_no")
    return member.join(heads, "label").select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "class_size", kept.alias("kept"), F.col("node").alias("text_sha256"))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_groups keeps, with their columns, whatever their names. Of rows equal in id and text any one stands for all."""
    groups, _ = scratch(near_groups(docs, similarity, id_col, text_col).select(F.col(id_col).alias("k_id"), F.col("text_sha256").alias("k_sha"), "kept"))
    rows = docs.select(F.col(id_col).alias("r_id"), F.sha2(text_or_empty(text_col), 256).alias("r_sha"), F.struct("*").alias("row"))
    same = F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_sha") == F.col("k_sha"))
    if groups.groupBy("k_id", "k_sha").count().where("count > 1").isEmpty():
        gone, _ = scratch(groups.where(~F.col("kept")).drop("kept"))
        return rows.join(broadcast_if_small(gone), same, "left_anti").select("row.*")
    left, _ = scratch(groups.where("kept").drop("kept"))
    return rows.join(left, same, "left_semi").dropDuplicates(["r_id", "r_sha"]).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_groups over all documents; nulls, ties, repeats, empty tables and extra columns as there."""
    return near_groups(table(spark, sf_dir, "documents"))
