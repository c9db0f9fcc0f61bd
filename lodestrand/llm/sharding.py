"""Sharding by a hierarchical weighted hash tree.

Leaves are shards, grouped into racks and racks into regions; a node weighs what the shards below it weigh. A node's draw for a key is an
exponential variate with its weight as rate, taken from a hash of the key and the node's own name. A key descends into the region
with the least draw, then into the least of that region's racks, then of that rack's shards, so a row costs the children of
three nodes however large the tree is. A changed weight alters the draws of the nodes above it only: keys move into or out of those,
never between two nodes whose weights stay. grow() puts a new shard into a region of its own, which then takes keys only into itself.

The tree is a constant of the plan, a list of children for every node, and not an expression for each shard.

Slots number the rows of a shard without gaps. Rows are ranked inside (shard, block) groups and shifted by the sizes of the
blocks before, so no task holds a whole shard. Block counts are shards x blocks rows, a bound that doesn't grow with the data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, table, text_or_empty, utf8


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 .. n-1 dealt in order over racks and regions."""
    return [Leaf(f"region{s // (per_rack * racks_per_region)}", f"rack{s // per_rack}", s) for s in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    shard = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(f"region of shard {shard}", "rack", shard, weight)]


def children(tree: Sequence[Leaf]) -> list[list[list[dict]]]:
    """For each of the three levels, the children of each node above: name, weight and the number of the child, of a leaf its shard."""
    levels: list[dict] = [{(): {}}, {}, {}]
    for x in tree:
        if x.weight > 0:
            path = (x.region, x.rack, x.shard)
            for depth in range(3):
                nodes = levels[depth].setdefault(path[:depth], {})
                nodes[path[: depth + 1]] = nodes.get(path[: depth + 1], 0.0) + x.weight
    if not levels[0][()]:
        raise ValueError("the tree needs a shard of positive weight")
    out = []
    for depth, level in enumerate(levels):
        number = {path: k for k, path in enumerate(levels[depth + 1])} if depth < 2 else None
        name = lambda path: f"shard {path[2]}" if len(path) == 3 else "/".join(path)
        out.append([[{"name": name(p), "weight": w, "child": p[2] if number is None else number[p]} for p, w in nodes.items()] for nodes in level.values()])
    return out


def _draw(key: Column, node: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, node["name"]), 12)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / node["weight"]


def tree_shard(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard a key descends to."""
    at = F.lit(0)
    for level in children(tree):
        nodes = F.from_json(F.lit(json.dumps(level)), "array<array<struct<name: string, weight: double, child: int>>>")
        draws = F.transform(F.get(nodes, at), lambda x: F.struct(_draw(key, x).alias("draw"), x["child"].alias("child")))
        at = F.array_min(draws)["child"]
    return at


def shard_documents(
    docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = 256
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The id alone decides the shard. A null id is a key of its own. Size is the text's UTF-8 bytes plus one; a null or empty
    text has size 1 and CRC 0. Repeated rows share a shard and get slots of their own. Other columns are ignored; an
    empty table gives an empty result. Without a grown tree, grown_shard is null.
    """
    parts = shuffle_partitions(docs.sparkSession)
    body = utf8(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"))
    rows = rows.select(
        "id", "size", "crc", tree_shard(F.col("id"), tree).alias("shard"),
        (tree_shard(F.col("id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).cast("int").alias("block"),
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = rows.repartition(parts, "shard", "block").withColumn("nth", F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "size", "crc")))
    return placed.join(F.broadcast(offsets), ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_documents over all documents, with 16 shards and one more; nulls, repeats, empty tables and extra columns as there."""
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(16), grow(even_tree(16)))
