"""Benchmark decontamination by SimHash of item-sized windows.

A window as long as an item can only be similar to it if the two share shingles of enough weight. So shingles of whole texts
are looked up among the items', each hit credits every window it lies in, and windows that reach the share of the item's
weight or number of shingles that the similarity asks for are fingerprinted. Fingerprints are cut into one block more than the Hamming
radius; a window within the radius agrees with the item in a block at least, so an equi-join on blocks finds it. Distances are
then taken in full, and survivors verified by exact weighted-shingle similarity. All of it is native SQL.

Items of equal words are one. An item's shingle weighs 1/m if m items have it, scaled so that the item's weights average 1, and a
window's other shingles weigh 1 each. A window passes by the greater of weighted and plain Jaccard similarity, so that neither
copies nor overlaps of items lose one that is similar by number of shingles. Items are broadcast while their shingles number less than
broadcast_shingles, some 60 bytes each; beyond that the joins shuffle, and adaptive execution splits hot keys. The index of blocks holds
fingerprints only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, scratch, table, text_or_empty

SHINGLE = 5


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingle_hashes(words: str, k: int = SHINGLE) -> Column:
    at = lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """64 bits: bit b is set if more of the hashes have it than not."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (bits, b) -> if(aggregate({hashes}, 0, (s, h) -> s + 2 * cast(shiftrightunsigned(h, b) & 1 as int) - 1) > 0, bits | shiftleft(1L, b), bits))"
    )


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius + 1 blocks of a 64-bit fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _blocks(fingerprint: str, radius: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << n) - 1}L").alias("bits")) for i, (a, n) in enumerate(block_bounds(radius))]))


def prepare_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, n, hashes, weights, weight, item_bits), one row per distinct words of at least SHINGLE, and (item, item_id), the ids that hold
    them; shorter ones match nothing. Hashes are distinct; weight is that of all."""
    held = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).distinct()
    held, _ = scratch(held.where(F.size("words") >= SHINGLE).withColumn("item", F.xxhash64("words")))
    items, _ = scratch(held.groupBy("item").agg(F.first("words").alias("words")).withColumn("all_hashes", shingle_hashes("words")))
    items = items.select("item", F.size("words").alias("n"), F.array_distinct("all_hashes").alias("hashes"), simhash("all_hashes").alias("item_bits"))
    each = items.select("item", "n", "item_bits", F.explode("hashes").alias("hash"))
    spread = each.groupBy("hash").agg((F.lit(1.0) / F.count("*")).alias("w"))
    packed = each.join(spread, "hash").groupBy("item", "n", "item_bits").agg(F.array_sort(F.collect_list(F.struct("hash", "w"))).alias("s"))
    scaled = F.expr("transform(s.w, w -> w * size(s) / aggregate(s.w, 0D, (a, x) -> a + x))")
    return packed.select("item", "n", "item_bits", F.col("s.hash").alias("hashes"), scaled.alias("weights"), F.size("s").cast("double").alias("weight")), held.select("item", "item_id")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_shingles: int = 500_000
) -> DataFrame:
    """One row per document id and item with a window of at least the similarity: id, item_id, start (in words), words, hamming,
    similarity and windows (how many windows passed); start is that of the most similar window, the first of equals.

    Windows are as long as the item, or the whole text where that is shorter. Null and empty texts match nothing; null ids
    and null item ids are reported as such; repeated rows count once. Other columns are ignored; empty tables give an empty
    result.
    """
    items, owners = prepare_items(benchmark)
    items, _ = scratch(items)
    small = items.select(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] <= broadcast_shingles
    near = F.broadcast if small else (lambda x: x)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    cut = rows.select("id", F.xxhash64("text").alias("body"), words_of(F.col("text")).alias("words"))
    spots = cut.select("id", "body", F.size("words").alias("have"), F.posexplode(shingle_hashes("words")).alias("at", "hash"))
    anchors = items.select("item", "n", "weight", "item_bits", F.explode(F.arrays_zip("hashes", "weights")).alias("s")).select("item", "n", "weight", "item_bits", F.col("s.hashes").alias("hash"), F.col("s.weights").alias("w"))
    hits = spots.join(near(anchors), "hash")
    last = F.greatest(F.lit(0), F.col("have") - F.col("n"))
    first_start = F.least(last, F.greatest(F.lit(0), F.col("at") + SHINGLE - F.col("n")))
    starts = F.explode(F.sequence(first_start, F.least(last, F.col("at")))).alias("start")
    credited = hits.select("id", "body", "item", "n", "weight", "item_bits", "w", starts)
    enough = (
        credited.groupBy("id", "body", "item", "n", "weight", "item_bits", "start")
        .agg(F.sum("w").alias("shared"), F.count("*").alias("count"))  # weight is the number of shingles too
        .where(F.greatest("shared", "count") >= similarity * F.col("weight") - 1e-9)
        .drop("shared", "count", "weight")
    )
    enough, _ = scratch(enough)
    suspects, _ = scratch(enough.select(F.col("id").alias("k"), F.col("body").alias("b")).distinct())
    same_row = F.col("id").eqNullSafe(F.col("k")) & (F.col("body") == F.col("b"))
    texts = rows.withColumn("body", F.xxhash64("text")).join(broadcast_if_small(suspects), same_row, "left_semi")
    texts = texts.dropDuplicates(["id", "body"]).select(F.col("id").alias("t_id"), F.col("body").alias("t_body"), words_of(F.col("text")).alias("words"))
    windows = enough.join(texts, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("body") == F.col("t_body")))
    windows = windows.select("id", "body", "item", "n", "item_bits", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("window"))
    # Written between the steps: the planner would else put the hashing inside the loops over bits.
    windows, _ = scratch(windows.select("*", shingle_hashes("window").alias("window_hashes")).drop("window"))
    windows, _ = scratch(windows.withColumn("window_bits", simhash("window_hashes")))
    key = ["item", "n", "item_bits"]
    blocked = windows.select("id", "body", *key, "start", "window_bits", "window_hashes", _blocks("window_bits", radius).alias("x")).select("*", "x.*").drop("x")
    indexed = items.select(*[F.col(c).alias(f"i_{c}") for c in key], _blocks("item_bits", radius).alias("x")).select("*", F.col("x.block").alias("i_block"), F.col("x.bits").alias("i_bits")).drop("x")
    same = F.col("item").eqNullSafe(F.col("i_item")) & (F.col("n") == F.col("i_n")) & (F.col("item_bits") == F.col("i_item_bits")) & (F.col("block") == F.col("i_block")) & (F.col("bits") == F.col("i_bits"))
    distance = F.bit_count(F.col("window_bits").bitwiseXOR(F.col("item_bits")))
    first_block = F.lit(True)
    for i, (a, n) in enumerate(block_bounds(radius)):  # a pair meets in every block it agrees in; it is kept in the first
        agrees = F.expr(f"(shiftrightunsigned(window_bits, {a}) & {(1 << n) - 1}L) = (shiftrightunsigned(item_bits, {a}) & {(1 << n) - 1}L)")
        first_block = first_block & ((F.col("block") <= i) | ~agrees)
    met = blocked.join(near(indexed), same).withColumn("hamming", distance).where((F.col("hamming") <= radius) & first_block)
    met = met.join(near(items.select("item", "hashes", "weights", "weight")), "item")
    shared = F.expr("aggregate(arrays_zip(hashes, weights), 0D, (s, x) -> s + if(array_contains(window_hashes, x.hashes), x.weights, 0D))")
    extra = F.size(F.array_except("window_hashes", "hashes"))
    plain = F.size(F.array_intersect("window_hashes", "hashes"))
    checked = met.withColumn("similarity", F.greatest(shared, plain) / (F.col("weight") + extra)).where(F.col("similarity") >= similarity - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", (-F.col("hamming")).alias("near"))).alias("best")
    found = checked.join(broadcast_if_small(owners), "item").groupBy("id", "item_id").agg(best, F.countDistinct("body", "item", "start").alias("windows"))
    return found.select(F.col("id").alias(id_col), "item_id", (-F.col("best.back")).alias("start"), F.col("best.n").alias("words"), (-F.col("best.near")).alias("hamming"), F.round("best.similarity", 9).alias("similarity"), "windows")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without any leak, with their columns. Rows that share an id share its fate."""
    leaked, _ = scratch(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("leaked_id")).distinct())
    return docs.join(broadcast_if_small(leaked), docs[id_col].eqNullSafe(leaked["leaked_id"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks of the whole benchmark in all documents; nulls, repeats, empty tables and extra columns as there."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
