"""Weights: the catalog compiler, binding to a cohort, quality counts and masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from additiva.functions.values import beta_alt, intercept
from additiva.operators.checks import checked, require_empty, require_unique

COUNTS = ("input_weights", "zero_weights", "excluded_weights", "duplicate_weights", "catalog_weights")


def flag_weights(weights: DataFrame, included: DataFrame | None = None) -> DataFrame:
    """Adds ``is_zero`` and ``is_excluded`` (not in the ID whitelist). Zero rows are not looked at further."""
    df = weights.withColumn("is_zero", F.col("weight") == 0)
    if included is None:
        return df.withColumn("is_excluded", F.lit(False))
    ids = included.select(F.col("id").alias("snp"), F.lit(True).alias("_in")).distinct()
    return df.join(ids, "snp", "left").withColumn("is_excluded", ~F.col("is_zero") & F.col("_in").isNull()).drop("_in")


def unfit() -> Column:
    """A blank ID or allele, or equal alleles."""
    return ~F.coalesce((F.col("snp") != "") & (F.col("effect") != "") & (F.col("other") != "") & (F.col("effect") != F.col("other")), F.lit(False))


UNFIT = "blank ID, blank allele or equal alleles"


def fused_checks(flagged: DataFrame) -> DataFrame:
    """Flagged weights in which reading an unfit row that counts is an error."""
    counts = ~F.col("is_zero") & ~F.col("is_excluded")
    return flagged.withColumn("weight", checked(F.col("weight"), counts & unfit(), UNFIT, F.col("score_idx"), F.col("snp"), F.col("effect"), F.col("other")))


def check_pairs(kept: DataFrame) -> None:
    """A variant has one unordered allele pair over all scores."""
    pair = F.struct(F.least("effect", "other"), F.greatest("effect", "other"))
    require_empty(kept.groupBy("snp").agg(F.min(pair).alias("a"), F.max(pair).alias("b")).where("a <> b").select("snp"), "variant with two allele pairs")


def check_alleles(kept: DataFrame) -> DataFrame:
    """IDs and alleles are filled, alleles differ, and a variant has one unordered pair over all scores."""
    require_empty(kept.where(unfit()).select("score_idx", "snp", "effect", "other"), UNFIT)
    check_pairs(kept)
    return kept


def catalog_rows(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("snp").alias("source_id"), F.least("effect", "other").alias("allele0"), F.greatest("effect", "other").alias("allele1"), "score_idx", "row_seq", "effect", "other", "weight")


def compile_catalog(weights: DataFrame, included: DataFrame | None = None, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """The catalog (source_id, allele0, allele1, score_idx, row_seq, effect, other, weight), to be stored by source and
    score, and the counts of each score. Repeated rows of a variant are kept and add up."""
    flagged = flag_weights(weights, included)
    kept = flagged.where(~F.col("is_zero") & ~F.col("is_excluded"))
    if validate:
        check_alleles(kept)
    return catalog_rows(kept), catalog_counts(flagged)


def catalog_counts(flagged: DataFrame, key: str = "snp") -> DataFrame:
    """COUNTS by score. Repeats are counted over (score, key) sums, so no key is held by a task."""
    kept = ~F.col("is_zero") & ~F.col("is_excluded")
    by_key = flagged.groupBy("score_idx", key).agg(F.count("*").alias("n"), F.count_if("is_zero").alias("z"), F.count_if("is_excluded").alias("x"), F.count_if(kept).alias("k"))
    return by_key.groupBy("score_idx").agg(
        F.sum("n").alias("input_weights"), F.sum("z").alias("zero_weights"), F.sum("x").alias("excluded_weights"),
        F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("duplicate_weights"), F.sum("k").alias("catalog_weights"),
    )


def bind(catalog: DataFrame, pvar: DataFrame, variant_map: DataFrame | None = None, validate: bool = True, fused: bool = False) -> DataFrame:
    """Every catalog row with its cohort variant, if any: (score_idx, row_seq, source_id, id, status, beta, intercept, weight, ref_effect).

    Pairs are compared without order. Blank IDs and ``.`` never match. Several ALT alleles or other alleles than the weights'
    are an error: with ``validate`` at once, with ``fused`` when a job reads ``beta``.
    """
    df = catalog
    if variant_map is not None:
        df = df.join(variant_map, "source_id", "left").withColumnRenamed("target_id", "id")
    else:
        df = df.withColumn("id", F.col("source_id"))
    there = pvar.where("id IS NOT NULL AND id NOT IN ('', '.')")
    if validate:
        require_unique(there, ["id"], "ID in two PVAR rows")
    there = there.select("id", F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt"))
    met = df.join(there, "id", "left")
    several = F.coalesce(F.contains("v_alt", F.lit(",")), F.lit(False))
    differ = F.col("v_ref").isNotNull() & ((F.col("allele0") != F.least("v_ref", "v_alt")) | (F.col("allele1") != F.greatest("v_ref", "v_alt")))
    beta = beta_alt(F.col("weight"), F.col("effect"), F.col("v_alt"))
    if fused:
        shown = [F.col(c) for c in ("id", "allele0", "allele1", "v_ref", "v_alt")]
        beta = checked(checked(beta, differ, "alleles disagree between weights and PVAR", *shown), several, "multiallelic variant in a score", *shown)
    elif validate:
        require_empty(met.where("contains(v_alt, ',')").select("id", "v_alt"), "multiallelic variant in a score")
        require_empty(met.where(differ).select("id", "allele0", "allele1", "v_ref", "v_alt"), "alleles disagree between weights and PVAR")
    found = F.col("v_ref").isNotNull()
    ref_effect = F.col("effect") == F.col("v_ref")
    return met.select(
        "score_idx", "row_seq", "source_id", "id",
        F.when(found, "matched").otherwise("missing_variant").alias("status"),
        F.when(found, beta).alias("beta"),
        F.when(found, intercept(F.col("weight"), F.col("effect"), F.col("v_ref"))).alias("intercept"),
        "weight", F.when(found, ref_effect).alias("ref_effect"),
    )


def bound_counts(bound: DataFrame) -> DataFrame:
    """Matched, missing and oriented weights and the REF intercept by score."""
    matched = F.col("status") == "matched"
    return bound.groupBy("score_idx").agg(
        F.count_if(matched).alias("matched_weights"), F.count_if(~matched).alias("missing_variants"),
        F.count_if(matched & ~F.col("ref_effect")).alias("alt_effects"), F.count_if(matched & F.col("ref_effect")).alias("ref_effects"),
        F.coalesce(F.sum("intercept"), F.lit(0.0)).alias("ref_intercept"),
    )


def totals(counts: DataFrame, by: str = "score_idx") -> DataFrame:
    """Counts by score and, with a null score, over all scores: both levels in one job."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c != by]
    return counts.rollup(by).agg(*sums)
