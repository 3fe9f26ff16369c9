"""Score fragments: weights compiled against the variant index and its reference support.

A fragment is a table of kept weight rows (score_idx, ordinal, tile_idx, row_seq, weight, ref_effect), stored by tile
and sorted inside, and a table of counts and masses of every score, also of those that the coverage screen excludes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from additiva.functions.values import BLOCK, fraction, tile_of
from additiva.operators.checks import InputError, require, require_empty, require_unique
from additiva.operators.support import MISSING_FREQUENCY, MISSING_VARIANT, USABLE

MASSES = ("nonzero_weight_l1", "nonzero_weight_l2_squared", "catalog_weight_l1", "catalog_weight_l2_squared", "reference_supported_weight_l1", "reference_supported_weight_l2_squared")
COUNTS = ("input_weights", "zero_weights", "excluded_weights", "duplicate_weights", "catalog_weights", "reference_supported_weights", "reference_missing_variant_weights", "reference_missing_frequency_weights")


def resolve_weights(weights: DataFrame, aliases: DataFrame, index: DataFrame, support: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Every weight row with ordinal, orientation and support state. Not in the index: excluded. Without a support
    table every variant counts as usable. Zero weights are not looked up."""
    place = index.select("ordinal", F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt"))
    if support is not None:
        place = place.join(support, "ordinal")
    else:
        place = place.withColumn("state", F.lit(USABLE))
    known = aliases.join(place, "ordinal").select(F.col("alias").alias("snp"), "ordinal", "v_ref", "v_alt", "state")
    met = weights.withColumn("is_zero", F.col("weight") == 0).join(known, "snp", "left")
    met = met.withColumn("is_excluded", ~F.col("is_zero") & F.col("ordinal").isNull()).withColumn("is_catalog", ~F.col("is_zero") & F.col("ordinal").isNotNull())
    met = met.withColumn("ref_effect", F.col("effect") == F.col("v_ref"))
    if validate:
        fits = ((F.col("effect") == F.col("v_alt")) & (F.col("other") == F.col("v_ref"))) | ((F.col("effect") == F.col("v_ref")) & (F.col("other") == F.col("v_alt")))
        require(met.where("is_catalog"), fits, "alleles disagree between weights and the variant index", ["score_idx", "snp", "effect", "other"])
    return met


def quality(resolved: DataFrame) -> DataFrame:
    """COUNTS and MASSES by score. Repeats are rows of (score, ordinal) after the first, summed over keys."""
    w, a = F.col("weight"), F.abs("weight")
    cat, ok = F.col("is_catalog"), F.col("is_catalog") & (F.col("state") == USABLE)
    some = lambda rule, value: F.sum(F.when(rule, value).otherwise(F.lit(0.0)))
    # Rows outside the index share no key, so that they do not meet in one task.
    by_key = resolved.withColumn("_key", F.coalesce(F.col("ordinal"), -1 - F.pmod(F.xxhash64("snp"), F.lit(1024)))).groupBy("score_idx", "_key").agg(
        F.count("*").alias("input_weights"), F.count_if("is_zero").alias("zero_weights"), F.count_if("is_excluded").alias("excluded_weights"),
        F.greatest(F.count_if(cat) - 1, F.lit(0)).alias("duplicate_weights"), F.count_if(cat).alias("catalog_weights"), F.count_if(ok).alias("reference_supported_weights"),
        F.count_if(cat & (F.col("state") == MISSING_VARIANT)).alias("reference_missing_variant_weights"), F.count_if(cat & (F.col("state") == MISSING_FREQUENCY)).alias("reference_missing_frequency_weights"),
        F.sum(a).alias("nonzero_weight_l1"), F.sum(w * w).alias("nonzero_weight_l2_squared"), some(cat, a).alias("catalog_weight_l1"), some(cat, w * w).alias("catalog_weight_l2_squared"),
        some(ok, a).alias("reference_supported_weight_l1"), some(ok, w * w).alias("reference_supported_weight_l2_squared"),
    )
    return by_key.groupBy("score_idx").agg(*(F.sum(c).alias(c) for c in (*COUNTS, *MASSES)))


def screened(qc: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Fractions and STATUS of every score."""
    if not 0 <= minimum <= 1:
        raise InputError("the minimum fraction must be between 0 and 1")
    share = fraction(F.col("reference_supported_weights"), F.col("catalog_weights"))
    return (
        qc.withColumn("reference_supported_fraction", share)
        .withColumn("reference_supported_l1_fraction", fraction(F.col("reference_supported_weight_l1"), F.col("catalog_weight_l1")))
        .withColumn("reference_supported_l2_squared_fraction", fraction(F.col("reference_supported_weight_l2_squared"), F.col("catalog_weight_l2_squared")))
        .withColumn("status", F.when(share >= minimum, "eligible").otherwise("excluded_low_reference_coverage"))
    )


def compile_fragment(weights: DataFrame, aliases: DataFrame, index: DataFrame, support: DataFrame | None = None, minimum: float = 0.0, block: int = BLOCK, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quality): the usable rows of eligible scores, and the counts of all scores."""
    if minimum and support is None:
        raise InputError("a minimum fraction needs a support table")
    resolved = resolve_weights(weights, aliases, index, support, validate)
    qc = screened(quality(resolved), minimum)
    rows = resolved.where(F.col("is_catalog") & (F.col("state") == USABLE)).join(qc.where("status = 'eligible'").select("score_idx"), "score_idx", "left_semi")
    rows = rows.select("score_idx", "ordinal", tile_of(F.col("ordinal"), block).alias("tile_idx"), "row_seq", "weight", "ref_effect")
    return rows, qc


def laid_out(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows in storage order: a tile in one place, sorted by score, ordinal and file order."""
    return (rows.repartitionByRange(parts, "tile_idx") if parts else rows.repartitionByRange("tile_idx")).sortWithinPartitions("tile_idx", "score_idx", "ordinal", "row_seq")


def edges_of(rows: DataFrame) -> DataFrame:
    """(score_idx, ordinal, beta, intercept) of fragment rows."""
    w, r = F.col("weight"), F.col("ref_effect")
    return rows.select("score_idx", "ordinal", F.when(r, -w).otherwise(w).alias("beta"), F.when(r, 2 * w).otherwise(F.lit(0.0)).alias("intercept"))


def merge_fragments(parts: list[tuple[DataFrame, DataFrame]], schema: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of fragments, given as (rows with score_id, scores (score_id, column_name)), as (rows, scores) numbered for output.

    Score IDs must differ between fragments. A schema selects, orders and renames; each of its scores must exist.
    """
    rows, scores = parts[0]
    for r, s in parts[1:]:
        rows, scores = rows.unionByName(r), scores.unionByName(s)
    require_unique(scores, ["score_id"], "score in two fragments")
    if schema is None:
        require_unique(scores, ["column_name"], "column name in two fragments")
        names = sorted(r["score_id"] for r in scores.select("score_id").collect())
        schema = rows.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], "output_idx int, score_id string").join(scores, "score_id").select("output_idx", "score_id", "column_name")
    require_empty(schema.join(scores, "score_id", "left_anti").select("score_id"), "score of the schema in no fragment")
    chosen = F.broadcast(schema.select(F.col("output_idx").alias("score_idx"), "score_id"))
    return rows.drop("score_idx").join(chosen, "score_id"), schema.select(F.col("output_idx").alias("score_idx"), "score_id", "column_name")


def variant_bits(rows: DataFrame) -> DataFrame:
    """The set of variants that a fragment refers to."""
    return rows.select("ordinal").distinct()


def merge_bits(sets: list[DataFrame]) -> DataFrame:
    out = sets[0].select("ordinal")
    for s in sets[1:]:
        out = out.union(s.select("ordinal"))
    return out.distinct()


def bit_buckets(bits: DataFrame) -> DataFrame:
    """The set as bitmaps of fixed-size buckets: (bucket, bits, n), mergeable with ``bitmap_or_agg``."""
    return bits.groupBy(F.expr("bitmap_bucket_number(ordinal + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(ordinal + 1))").alias("bits")).withColumn("n", F.expr("bitmap_count(bits)"))


def availability(rows: DataFrame, support: DataFrame) -> DataFrame:
    """How much of each score a target cohort supports, by rows, absolute and squared weight."""
    met = rows.join(support, "ordinal")
    ok, a = F.col("state") == USABLE, F.abs("weight")
    sums = met.groupBy("score_idx").agg(
        F.count("*").alias("reference_weight_count"), F.count_if(ok).alias("target_available_weight_count"),
        F.sum(a).alias("reference_abs_weight"), F.sum(F.when(ok, a).otherwise(F.lit(0.0))).alias("target_available_abs_weight"),
        F.sum(a * a).alias("reference_squared_weight"), F.sum(F.when(ok, a * a).otherwise(F.lit(0.0))).alias("target_available_squared_weight"),
    )
    return sums.select(
        "score_idx", "reference_weight_count", "target_available_weight_count", fraction(F.col("target_available_weight_count"), F.col("reference_weight_count")).alias("target_available_fraction"),
        "reference_abs_weight", "target_available_abs_weight", fraction(F.col("target_available_abs_weight"), F.col("reference_abs_weight")).alias("target_available_abs_weight_fraction"),
        "reference_squared_weight", "target_available_squared_weight", fraction(F.col("target_available_squared_weight"), F.col("reference_squared_weight")).alias("target_available_squared_weight_fraction"),
    )


def tile_statistics(rows: DataFrame) -> DataFrame:
    """(tile_idx, n_scores, n_variants, n_edges)."""
    return rows.groupBy("tile_idx").agg(F.count_distinct("score_idx").alias("n_scores"), F.count_distinct("ordinal").alias("n_variants"), F.count("*").alias("n_edges"))
