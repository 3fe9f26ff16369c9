"""Stored fragments and genotypes: by tile, so that a run reads the tiles it needs, or in buckets, so that it joins without a shuffle.

By tile. Tables are partitioned by tile. ``in_tiles`` semi-joins one with the tiles of a filtered table: Spark prunes its
partitions at run time by the broadcast set of tiles. That set is one number a tile, some 2,000 variants each, and counted
before it is broadcast.

In buckets. Tables of edges and calls are dealt out by their key once, when they are written, and sorted inside; runs that join
them again and again then read matching buckets side by side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.operators.checks import broadcast_if_small
from additiva.operators.fragments import laid_out


def store_by_tile(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Fragment rows, or any table with ``tile_idx``, one folder a tile, written by ``parts`` tasks or as the session has it."""
    ranges = lambda *keys: rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ordered = laid_out(rows, parts) if {"score_idx", "row_seq"} <= set(rows.columns) else ranges("tile_idx", "ordinal").sortWithinPartitions("tile_idx", "ordinal")
    ordered.write.partitionBy("tile_idx").parquet(path)


def tiles_of(table: DataFrame, wanted: Column) -> DataFrame:
    """(tile_idx) of the rows of ``table`` that are wanted."""
    return table.where(wanted).select("tile_idx").distinct()


def in_tiles(spark: SparkSession, path: str, schema: str, tiles: DataFrame) -> DataFrame:
    """The rows of a table by tile that lie in ``tiles``; other tiles are not read."""
    return spark.read.schema(f"{schema}, tile_idx long").parquet(path).join(broadcast_if_small(tiles), "tile_idx", "left_semi")


def store_in_buckets(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table at ``path`` in sorted buckets by ``key``, for this session's catalog."""
    name = f"buckets_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
