"""Readers of the domain's files: variants, samples, maps, weights, manifests and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.values import number
from additiva.operators.checks import InputError, checked, require, require_empty, require_unique
from additiva.sources.text import header_of, read_list, read_table, read_tables, resolve


def read_pvar(spark: SparkSession, path: str, ids: DataFrame | None = None, fused: bool = False) -> DataFrame:
    """(pgen_variant_idx, chrom, id, ref, alt); the index counts all rows, also those that the ID filter drops."""
    df = read_table(spark, path, ["CHROM", "ID", "REF", "ALT"], numbered="pgen_variant_idx", skip_meta=True, fused=fused).toDF("pgen_variant_idx", "chrom", "id", "ref", "alt")
    return df.join(ids.select("id").distinct(), "id", "left_semi").select(df.columns) if ids is not None else df


def read_indexed_pvar(spark: SparkSession, path: str, fused: bool = False) -> DataFrame:
    """(pgen_variant_idx, id, ref, alt): no chromosome is needed where variants are found by alias."""
    return read_table(spark, path, ["ID", "REF", "ALT"], numbered="pgen_variant_idx", skip_meta=True, fused=fused).toDF("pgen_variant_idx", "id", "ref", "alt")


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, fid, iid); fid is null without such a column."""
    df = read_table(spark, path, ["IID"], ["FID"], numbered="sample_idx", skip_meta=True)
    return df.select("sample_idx", (F.col("FID") if "FID" in df.columns else F.lit(None).cast("string")).alias("fid"), F.col("IID").alias("iid"))


def read_variant_map(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, target_id), both unique and not blank."""
    df = read_table(spark, path, ["SOURCE_ID", "TARGET_ID"]).toDF("source_id", "target_id")
    if df.isEmpty():
        raise InputError(f"{path} has no rows")
    require(df, (F.col("source_id") != "") & (F.col("target_id") != ""), "blank ID in the variant map")
    require_unique(df, ["source_id"], "SOURCE_ID is mapped twice")
    return require_unique(df, ["target_id"], "TARGET_ID is mapped twice")


def read_variant_list(spark: SparkSession, path: str, source: str = "SOURCE_ID", target: str = "TARGET_ID", ref: str = "REF", alt: str = "ALT") -> DataFrame:
    """(ordinal, source_id, target_id, ref, alt) in file order."""
    return read_table(spark, path, list(dict.fromkeys([source, target, ref, alt])), numbered="ordinal").select("ordinal", F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.col(ref).alias("ref"), F.col(alt).alias("alt"))


def read_manifest(spark: SparkSession, path: str, form: str = "catalog") -> DataFrame:
    """(score_idx, score_id, column_name, display_name, path) in file order.

    ``catalog`` names a score by the first of COLUMN_NAME, SCORE, SCORE_ID; ``fragment`` has a stable ID (the first of
    SCORE_ID, SCORE, COLUMN_NAME) besides.
    """
    names = header_of(spark, path)
    pick = lambda *options: next((c for c in options if c in names), None)
    column = pick("COLUMN_NAME", "SCORE", "SCORE_ID")
    stable = pick("SCORE_ID", "SCORE", "COLUMN_NAME") if form == "fragment" else column
    if column is None:
        raise InputError(f"{path} has no column with score names")
    rows = read_table(spark, path, list(dict.fromkeys([column, stable, "PATH"])), ["DISPLAY_NAME"]).collect()
    if not rows:
        raise InputError(f"{path} lists no score")
    out = [(k, r[stable], r[column], r["DISPLAY_NAME"] if "DISPLAY_NAME" in names else r[column], resolve(path, r["PATH"])) for k, r in enumerate(rows)]
    for place, what in ((1, "score ID"), (2, "score name")):
        if len({r[place] for r in out}) < len(out) or any(not r[place] for r in out):
            raise InputError(f"{path}: blank or repeated {what}")
    return spark.createDataFrame(out, "score_idx int, score_id string, column_name string, display_name string, path string")


def read_weights(spark: SparkSession, manifest: DataFrame, fused: bool = False) -> DataFrame:
    """(score_idx, row_seq, snp, effect, other, weight) of all weight files of a manifest.

    All files are one read; one under several scores fans out. A malformed number is an error on any row: at once, or if
    ``fused``, when a job reads it.
    """
    columns = ["SNP", "EFFECT_ALLELE", "OTHER_ALLELE", "EFFECT_ALLELE_WEIGHT"]
    paths = sorted({r["path"] for r in manifest.select("path").collect()})
    rows = read_tables(spark, paths, columns, numbered="row_seq", file="path", fused=fused).toDF("path", "row_seq", "snp", "effect", "other", "text")
    rows = rows.withColumn("weight", number(F.col("text")))
    if fused:
        rows = rows.withColumn("weight", checked(F.col("weight"), F.col("weight").isNull(), "invalid EFFECT_ALLELE_WEIGHT", F.col("path"), F.col("row_seq"), F.col("text")))
    else:
        require_empty(rows.where("weight IS NULL").select("path", "row_seq", "text"), "invalid EFFECT_ALLELE_WEIGHT")
    return rows.join(F.broadcast(manifest.select("score_idx", "path")), "path").select("score_idx", "row_seq", "snp", "effect", "other", "weight")


def read_score_schema(spark: SparkSession, path: str) -> DataFrame:
    """(output_idx, score_id, column_name): which scores to give, in which order, under which name."""
    names = header_of(spark, path)
    stable = next((c for c in ("SCORE_ID", "SCORE", "COLUMN_NAME") if c in names), None)
    if stable is None:
        raise InputError(f"{path} has no column with score IDs")
    rows = read_table(spark, path, [stable], ["COLUMN_NAME"]).collect()
    out = [(k, r[stable], r["COLUMN_NAME"] if "COLUMN_NAME" in names else r[stable]) for k, r in enumerate(rows)]
    for place, what in ((1, "score ID"), (2, "column name")):
        if not out or len({r[place] for r in out}) < len(out) or any(not r[place] for r in out):
            raise InputError(f"{path}: no, blank or repeated {what}")
    return spark.createDataFrame(out, "output_idx int, score_id string, column_name string")


def read_pfile_list(spark: SparkSession, path: str) -> list[dict[str, str]]:
    return read_list(spark, path, ["PGEN", "PVAR", "PSAM"], "fileset")


def read_pvar_list(spark: SparkSession, path: str) -> list[str]:
    return [r["PVAR"] for r in read_list(spark, path, ["PVAR"], "PVAR")]


def read_fragment_list(spark: SparkSession, path: str) -> list[str]:
    return [r["FRAGMENT"] for r in read_list(spark, path, ["FRAGMENT|PATH"], "fragment")]


def read_bitset_list(spark: SparkSession, path: str) -> list[str]:
    return [r["VARIANT_BITS"] for r in read_list(spark, path, ["VARIANT_BITS|PATH"], "bitset")]
