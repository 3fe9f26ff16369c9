"""Sharding by a hierarchical weighted hash tree.

A topology is a list of leaves ``Leaf(region, rack, shard, weight)``. A key descends region, rack and shard; at each
node every child draws ``-ln(u) / weight`` from a hash of (key, path of the child) and the smallest draw wins, so a
child gets its share of the weight. A change of weight inside one subtree moves keys only into or out of the nodes on
its path. ``grown`` adds a shard as a region of its own: no other weight changes, so keys move only into it.

The law is ``key``: the key and the topology decide, without looking at other rows. Each row also gets a slot, gapless
from 0 within its shard: rows are dealt evenly into small buckets by their place in the scan (not by content, so equal
rows or keys share none), numbered inside, and a table of bucket counts gives the offsets. That table has shards x
BUCKETS rows at most whatever the input (16,384 for 16 shards, under 2 MB broadcast), so neither a hot shard, a hot key
nor the driver meets all rows of a shard.

Defined cases: a null text has size 1 and checksum 0 (that of the empty text); a null key is hashed as such and goes
to one shard; repeated rows get the same shard and slots of their own (which of them gets which is not defined); an empty table gives an empty result. Columns
other than key and text are not read. Everything is DataFrame operations.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from additiva.llm.common import checkpointed, table


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float


#: Hash buckets of a shard within which rows are numbered; the table of their counts is broadcast.
BUCKETS = 1024


def topology(n_shards: int = 16, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal weights; shards are dealt to racks in order."""
    return [Leaf(f"region{i * regions // n_shards}", f"rack{i * regions * racks // n_shards % racks}", i, 1.0) for i in range(n_shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    n = max(leaf.shard for leaf in leaves) + 1
    return [*leaves, Leaf(f"added{n}", "rack0", n, weight)]


def _draw(key: Column, children: list[tuple[str, float]]) -> Column:
    """Name of the child with the smallest weighted draw."""
    draws = []
    for path, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(2**53)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(path).alias("path")))
    return draws[0]["path"] if len(draws) == 1 else F.array_min(F.array(*draws))["path"]


def _level(key: Column, at: Column | None, tree: dict[str, list[tuple[str, float]]]) -> Column:
    choice = None
    for parent, children in tree.items():
        if at is None:
            return _draw(key, children)
        choice = F.when(at == parent, _draw(key, children)) if choice is None else choice.when(at == parent, _draw(key, children))
    return choice


def assign(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds the shard of ``key``; a leaf without weight gets nothing."""
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    trees: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    shards = {}
    for leaf in leaves:
        path = ""
        for tree, part in zip(trees, (leaf.region, leaf.rack, str(leaf.shard)), strict=True):
            child = f"{path}/{part}"
            tree.setdefault(path, {}).setdefault(child, 0.0)
            tree[path][child] += leaf.weight
            path = child
        shards[path] = leaf.shard
    at = None
    for k, tree in enumerate(trees):
        df = df.withColumn(f"__{out}{k}", _level(key, at, {p: list(c.items()) for p, c in tree.items()}))
        at = F.col(f"__{out}{k}")
    number = F.element_at(F.split(at, "/"), -1).cast("int")
    return df.withColumn(out, number).drop(*(f"__{out}{k}" for k in range(3)))


def place(docs: DataFrame, leaves: list[Leaf], id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Size, checksum, shard, slot and the shard after growth, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(assign(rows, F.col("__key"), leaves, "shard"), F.col("__key"), grown(leaves), "grown_shard")
    rows = checkpointed(rows.withColumn("__bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    order = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "__bucket").count().select("shard", "__bucket", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__key", "size", "text_crc32")
    numbered = rows.withColumn("__n", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "__bucket"])
    return numbered.select(F.col("__key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__n")).cast("long").alias("slot"), "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), topology(16))


QUERIES = {"op5_sharding": op5_sharding}
SQL: dict[str, str] = {}
