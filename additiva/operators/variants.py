"""Variant index: ordinals, aliases, lineage signature, and lookups by alias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from additiva.functions.values import BLOCK, stripped, tile_of, tile_size
from additiva.operators.checks import InputError, require, require_empty, require_unique


def build_index(variant_list: DataFrame, strip_prefix: str = "", block: int = BLOCK) -> DataFrame:
    """(ordinal, source_id, target_id, ref, alt, block, tile_idx); the stripped target replaces the original one."""
    tile_size(block)
    df = variant_list
    if strip_prefix:
        df = df.withColumn("target_id", stripped(F.col("target_id"), strip_prefix))
        require(df, F.col("target_id").isNotNull(), f"target ID without the prefix {strip_prefix}", ["ordinal", "source_id"])
    filled = F.lit(True)
    for c in ("source_id", "target_id", "ref", "alt"):
        filled = filled & F.coalesce(F.col(c) != "", F.lit(False))
    require(df, filled & (F.col("ref") != F.col("alt")), "blank field or equal alleles in the variant list")
    require(df, F.col("ordinal") < 1 << FAN_BITS * LEVELS, "too many rows in the variant list")
    return df.select("ordinal", "source_id", "target_id", "ref", "alt", F.floor(F.col("ordinal") / block).cast("long").alias("block"), tile_of(F.col("ordinal"), block).alias("tile_idx"))


def aliases_of(index: DataFrame, check: bool = True) -> DataFrame:
    """(alias, ordinal): source and target IDs; an alias of two variants is an error."""
    both = index.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("alias"), "ordinal")
    return require_unique(both, ["alias"], "alias of two variants") if check else both


#: Digests that one digest covers, and levels of digests: 256^4 rows at most.
FAN_BITS, LEVELS = 8, 4


def lineage(index: DataFrame) -> DataFrame:
    """(signature): SHA-256 over all rows in order, as a tree, in one row.

    A row's digest covers its fields with their lengths. ``2 ** FAN_BITS`` neighbours' digests are joined in order and digested, level by
    level, so a task holds that many; the last one covers the number of rows too.
    """
    field = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c))
    rows = index.select(F.col("ordinal").cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.sha2(F.concat(*(field(c) for c in ("source_id", "target_id", "ref", "alt"))), 256).alias("h"))
    for _ in range(LEVELS):
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]))
        rows = rows.groupBy(F.shiftright("at", FAN_BITS).alias("at")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("h"))
    return rows.select(F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("h")), 256).alias("signature"))


def signature(index: DataFrame) -> str:
    row = lineage(index).first()
    if row is None:
        raise InputError("the variant list is empty")
    return row[0]


def locate(pvar: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """(ordinal, input_idx, pgen_variant_idx) of a cohort's variants. Alleles must be those of the index, in order."""
    if "input_idx" not in pvar.columns:
        pvar = pvar.withColumn("input_idx", F.lit(0))
    met = pvar.join(aliases, F.col("id") == F.col("alias")).join(index.select("ordinal", F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt")), "ordinal")
    require_empty(met.where("ref <> v_ref OR alt <> v_alt OR contains(alt, ',')").select("id", "ref", "alt", "v_ref", "v_alt"), "PVAR alleles disagree with the variant index")
    return require_unique(met.select("ordinal", "input_idx", "pgen_variant_idx"), ["ordinal"], "variant in two PVAR rows")
