"""Genotype sources.

The engine works on exceptions from a common dosage (see ``operators.scoring``). Containers of the fixed-width layouts
(``sources.pgen``) give both; Parquet tables of calls and text in the public VCF layout, read as lines and expanded in the plan,
give exceptions from 0. ``register`` is the seam for other readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.values import DOSAGE_UNIT, dosage
from additiva.sources import pgen
from additiva.sources.text import header_of

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(suffix: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader for paths with this suffix; gives (pgen_variant_idx, sample_idx, dosage)."""
    _READERS[suffix] = reader


def _gt_dosage(call: Column) -> Column:
    """ALT dosage of a call such as 0/1 or 1|1; null if an allele is missing."""
    gt = F.split_part(call, F.lit(":"), F.lit(1))
    return F.when(~gt.contains("."), F.length(gt) - F.length(F.translate(gt, "1", "")))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(id, ref, alt, sample_idx, dosage): all calls but those equal to the common dosage 0.

    Lines are parsed in the plan; each expands into its non-zero calls only.
    """
    names = header_of(spark, path, skip_meta=True)
    first = names.index("FORMAT") + 1
    f = F.col("f")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("f"))
    calls = F.transform(F.slice(f, first + 1, len(names)), lambda c, i: F.struct(i.cast("long").alias("sample_idx"), _gt_dosage(c).cast("double").alias("dosage")))
    kept = F.filter(calls, lambda c: c["dosage"].isNull() | (c["dosage"] != 0))
    return lines.select(f[names.index("ID")].alias("id"), f[names.index("REF")].alias("ref"), f[names.index("ALT")].alias("alt"), F.explode(kept).alias("c")).select("id", "ref", "alt", "c.sample_idx", "c.dosage")


def fixed_point(calls: DataFrame, column: str = "dosage16") -> DataFrame:
    """Stored fixed-point dosages to numbers; the code 65535 is missing."""
    value = F.col(column)
    return calls.withColumn("dosage", F.when((value >= 0) & (value <= 2 * DOSAGE_UNIT), dosage(value))).drop(column)


def header_counts(path: str, n_samples: int | None = None) -> tuple[int, int] | None:
    """(variants, samples) that a container states itself."""
    return pgen.counts_of(path, n_samples if pgen.mode_of(path) == 1 else None) if path.endswith(".pgen") else None


def read_genotypes(spark: SparkSession, path: str, n_samples: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(calls, common dosages) of a path by its suffix; without common dosages, samples without a call have dosage 0."""
    if path.endswith(".pgen") and ".pgen" not in _READERS:
        return pgen.calls_and_common(pgen.read_pgen(spark, path, n_samples))
    return read_calls(spark, path), None


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a path by its suffix; without a known one, a Parquet table of exceptions."""
    for suffix, reader in _READERS.items():
        if path.endswith(suffix):
            return reader(spark, path)
    if any(path.endswith(s) for s in (".vcf", ".vcf.gz", ".vcf.zst")):
        return read_vcf(spark, path)
    calls = spark.read.parquet(path)
    return fixed_point(calls) if "dosage16" in calls.columns else calls
