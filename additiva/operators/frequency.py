"""Expected ALT dosages from frequency tables of four forms.

The form follows from the columns a table has, not from its rows: a mean dosage, else an ALT frequency, else an ALT
count over the observations, else a REF count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.shared import stored
from additiva.functions.values import allele_value, ascii_upper, is_missing, number
from additiva.operators.checks import InputError, require_empty, require_unique
from additiva.sources.text import read_table


def normalise(rows: DataFrame) -> DataFrame:
    """(id, ref, alt, alt_dosage_mean) of the usable rows of a table with upper-case string columns.

    A missing value or no observations make a row unusable, which is not an error; a negative count, a mean outside
    0 to 2, a malformed number, a named value that is missing (``T=NA``), or a blank allele or several ALT alleles are one.
    """
    names = set(rows.columns)
    alt_name = next((c for c in ("ALT", "ALT1") if c in names), None)
    if not {"ID", "REF"} <= names or alt_name is None:
        raise InputError("a frequency table needs ID, REF and ALT")
    first = lambda *options: next((c for c in options if c in names), None)
    df = rows.withColumn("_ref", ascii_upper(F.col("REF"))).withColumn("_alt", ascii_upper(F.col(alt_name)))
    alt = F.col("_alt")
    require_empty(df.where((F.col("_ref") == "") | (alt == "") | alt.contains(",")).select("ID", "REF", alt_name), "not biallelic")
    observed = F.col("OBS_CT") if "OBS_CT" in names else F.lit(None).cast("string")
    if c := first("ALT_DOSAGE_MEAN"):
        text, scale, counted = F.col(c), F.lit(1.0), False
    elif c := first("ALT_FREQS", "ALT1_FREQ"):
        text, scale, counted = allele_value(F.col(c), alt), F.lit(2.0), False
    elif (c := first("ALT_CTS", "ALT1_CT")) and "OBS_CT" in names:
        text, scale, counted = allele_value(F.col(c), alt), F.lit(2.0), True
    elif (c := first("REF_CT")) and "OBS_CT" in names:
        text, scale, counted = F.col(c), F.lit(2.0), True
    else:
        raise InputError("a frequency table needs ALT_DOSAGE_MEAN, ALT_FREQS, ALT_CTS with OBS_CT, or REF_CT with OBS_CT")
    df = df.withColumn("_raw", F.col(c)).withColumn("_text", text).withColumn("_obs_text", observed)
    df = df.withColumn("_value", number(F.col("_text"))).withColumn("_obs", number(F.col("_obs_text")))
    if counted:
        skip = is_missing(F.col("_obs_text")) | (F.col("_obs") == 0)
        bad = F.col("_obs").isNull() | (F.col("_obs") < 0) | F.col("_value").isNull()
        share = (F.col("_obs") - F.col("_value")) if c == "REF_CT" else F.col("_value")
        mean = F.try_divide(scale * share, F.col("_obs"))
    else:
        skip, bad, mean = is_missing(F.col("_raw")), F.col("_value").isNull(), scale * F.col("_value")
    used = df.where(~F.coalesce(skip, F.lit(False)))
    require_empty(used.where(F.coalesce(bad, F.lit(True))).select("ID", "_raw", "_obs_text"), "invalid frequency value")
    out = used.select(F.col("ID").alias("id"), F.col("_ref").alias("ref"), alt.alias("alt"), mean.alias("alt_dosage_mean"))
    require_empty(out.where("NOT (alt_dosage_mean >= 0 AND alt_dosage_mean <= 2)"), "expected ALT dosage outside 0 to 2")
    return out


def read_frequencies(spark: SparkSession, path: str, ids: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Usable rows of a frequency file, limited to ``ids`` if given; a second usable row of an ID is an error.

    With ``once`` the text is read once, into a table that the checks and later steps read.
    """
    known = ["ALT", "ALT1", "ALT_DOSAGE_MEAN", "ALT_FREQS", "ALT1_FREQ", "ALT_CTS", "ALT1_CT", "REF_CT", "OBS_CT"]
    rows = read_table(spark, path, ["ID", "REF"], known, upper_header=True, fused=once)
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").alias("ID")).distinct(), "ID", "left_semi")
    if once:
        rows = stored(rows)
    found = require_unique(normalise(rows), ["id"], "two frequency rows of one ID")
    if ids is None and found.isEmpty():
        raise InputError(f"{path} has no frequency rows")
    return found


def indexed(frequencies: DataFrame, aliases: DataFrame, variants: DataFrame) -> DataFrame:
    """(ordinal, alt_dosage_mean): rows found by any alias. Alleles must be those of the index, one row an ordinal."""
    met = frequencies.join(aliases, F.col("id") == F.col("alias")).join(variants.select("ordinal", F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt")), "ordinal")
    require_empty(met.where("ref <> v_ref OR alt <> v_alt").select("id", "ref", "alt", "v_ref", "v_alt"), "frequency alleles disagree with the variant index")
    return require_unique(met.select("ordinal", "alt_dosage_mean"), ["ordinal"], "two frequency rows of one variant")
