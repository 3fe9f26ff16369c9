"""Sparse form of dense calls: each variant's most frequent dosage becomes its common one, only samples that differ stay rows.

The counts by (variant, dosage) are combined map-side, so a variant called in every sample is a few rows before the
shuffle, and the most frequent dosage is a maximum over those: no task holds a variant's samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger than any dosage: missing calls come last among equally frequent ones.
_LAST = 9.0


def most_exceptions(samples: int) -> int:
    """Exceptions up to which a variant is kept in sparse form; none for a single sample."""
    return min(samples - 1, max(1, 3 * (samples // 8)))


def common_dosages(calls: DataFrame, n_samples: int, key: str = "id") -> DataFrame:
    """(key, common, missing, exceptions, dense, listed) of every variant of (key, sample_idx, dosage), a sample listed once at most.

    Unlisted samples have dosage 0. ``common`` is the most frequent dosage, the smallest of equals, null with ``missing`` if
    no call is most frequent. A ``dense`` variant has too many exceptions: its common dosage is 0.
    """
    counts = calls.groupBy(key, "dosage").agg(F.count("*").alias("n"))
    zero = F.coalesce(F.sum(F.when(F.col("dosage") == 0, F.col("n"))), F.lit(0))
    best = F.max(F.when(F.col("dosage").isNull() | (F.col("dosage") != 0), F.struct("n", (-F.coalesce(F.col("dosage").cast("double"), F.lit(_LAST))).alias("before"))))
    found = counts.groupBy(key).agg(F.sum("n").alias("listed"), zero.alias("zero"), best.alias("best")).withColumn("zero", F.col("zero") + n_samples - F.col("listed"))
    is_zero = F.col("best").isNull() | (F.col("zero") >= F.col("best.n"))
    found = found.withColumn("exceptions", n_samples - F.when(is_zero, F.col("zero")).otherwise(F.col("best.n")))
    found = found.withColumn("dense", (F.lit(n_samples) == 1) | (F.col("exceptions") > most_exceptions(n_samples)))
    value = F.when(F.col("dense") | is_zero, F.lit(0.0)).otherwise(-F.col("best.before"))
    missing = value == _LAST
    return found.select(key, F.when(~missing, value).alias("common"), missing.alias("missing"), "exceptions", "dense", "listed")


def sparse_form(calls: DataFrame, samples: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(calls, common) for scoring, equal to ``calls`` in which unlisted samples have dosage 0.

    Where the common dosage is not 0, unlisted samples become rows: those variants meet all samples, which lists no more than
    the exceptions that the cut-off allows.
    """
    common = common_dosages(calls, samples.count(), key)
    met = calls.select(key, "sample_idx", "dosage").join(common.select(key, "common"), key)
    differ = met.where(~F.col("dosage").cast("double").eqNullSafe(F.col("common"))).select(key, "sample_idx", F.col("dosage").cast("double").alias("dosage"))
    n = samples.count()
    open_ = common.where((F.col("missing") | (F.col("common") != 0)) & (F.col("listed") < n)).select(key)
    unlisted = open_.crossJoin(samples.select("sample_idx")).join(calls.select(key, "sample_idx"), [key, "sample_idx"], "left_anti").select(key, "sample_idx", F.lit(0.0).alias("dosage"))
    return differ.unionByName(unlisted), common.select(key, "common")
