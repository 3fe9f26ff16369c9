"""Reference support of variants: missing variant, missing frequency, usable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_VARIANT, MISSING_FREQUENCY, USABLE = 0, 1, 2


def build_support(index: DataFrame, located: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(ordinal, state) of every variant of the index."""
    there = located.select("ordinal", F.lit(True).alias("_there"))
    known = frequencies.where("alt_dosage_mean IS NOT NULL").select("ordinal", F.lit(True).alias("_known"))
    state = F.when(F.col("_there").isNull(), MISSING_VARIANT).when(F.col("_known").isNull(), MISSING_FREQUENCY).otherwise(USABLE)
    return index.select("ordinal").join(there, "ordinal", "left").join(known, "ordinal", "left").select("ordinal", state.cast("int").alias("state"))


def summary(support: DataFrame) -> DataFrame:
    return support.groupBy("state").agg(F.count("*").alias("n_variants"))
