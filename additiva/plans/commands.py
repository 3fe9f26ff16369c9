"""The composite commands: build index and support, compile, merge, report, score, convert.

Each reads its inputs, validates them up front, composes operators and writes Parquet tables (its own layouts) with a
small metadata text. Options that exclude each other are refused before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.values import BLOCK
from additiva.operators import fragments as fr
from additiva.operators import frequency, scoring
from additiva.operators.checks import InputError, require_empty
from additiva.operators.support import build_support, summary
from additiva.operators.variants import aliases_of, build_index, locate, signature
from additiva.operators.weights import compile_catalog
from additiva.plans.artefacts import eligible_scores, index_of, meta_of, quality_of, rows_of, same_lineage
from additiva.plans.score import score  # noqa: F401  one of the commands
from additiva.sinks.matrix import read_matrix
from additiva.sinks.writers import REFUSE, Progress, write_metadata, write_table, write_wide_parquet
from additiva.sources import inputs


def build_variant_index(spark: SparkSession, variant_list: str, out: str, *, source: str = "SOURCE_ID", target: str = "TARGET_ID", strip_prefix: str = "", ref: str = "REF", alt: str = "ALT", block: int = BLOCK, progress: Progress | None = None) -> None:
    log = progress or Progress("variant_index")
    log.event("start")
    index = build_index(inputs.read_variant_list(spark, variant_list, source, target, ref, alt), strip_prefix, block)
    index.write.mode(REFUSE).parquet(f"{out}/variants")
    stored = spark.read.parquet(f"{out}/variants")
    aliases_of(stored).write.mode(REFUSE).parquet(f"{out}/aliases")
    n = stored.count()
    write_metadata(spark, {"signature": signature(stored), "variants": n, "block_size": block}, f"{out}/metadata", REFUSE)
    log.event("complete", variants=n)


def build_support_index(spark: SparkSession, index_path: str, frequency_path: str, out: str, *, pvar: str | None = None, pvar_list: str | None = None, progress: Progress | None = None) -> None:
    if (pvar is None) == (pvar_list is None):
        raise InputError("give exactly one of pvar and pvar_list")
    log = progress or Progress("support_index")
    log.event("start")
    index, aliases = index_of(spark, index_path)
    paths = [pvar] if pvar else inputs.read_pvar_list(spark, pvar_list)
    located = locate(_shards([inputs.read_indexed_pvar(spark, p) for p in paths]), aliases, index)
    log.event("pvar_loaded", files=len(paths))
    means = frequency.indexed(frequency.read_frequencies(spark, frequency_path), aliases, index)
    log.event("frequencies_loaded")
    build_support(index, located, means).write.mode(REFUSE).parquet(f"{out}/states")
    counts = {str(r["state"]): r["n_variants"] for r in summary(spark.read.parquet(f"{out}/states")).collect()}
    write_metadata(spark, {"signature": meta_of(spark, index_path)["signature"], "states": counts}, f"{out}/metadata", REFUSE)
    log.event("complete", **{f"state_{k}": v for k, v in counts.items()})


def _shards(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].withColumn("input_idx", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("input_idx", F.lit(k)))
    return out


def compile_source_catalog(spark: SparkSession, manifest: str, out: str, *, included_ids: DataFrame | None = None, progress: Progress | None = None) -> None:
    log = progress or Progress("compile")
    log.event("start")
    scores = inputs.read_manifest(spark, manifest)
    log.event("manifest_loaded", scores=scores.count())
    catalog, counts = compile_catalog(inputs.read_weights(spark, scores), included_ids)
    catalog.repartitionByRange("source_id").sortWithinPartitions("source_id", "score_idx", "row_seq").write.mode(REFUSE).parquet(f"{out}/weights")
    counts.write.mode(REFUSE).parquet(f"{out}/counts")
    scores.write.mode(REFUSE).parquet(f"{out}/scores")
    stored = spark.read.parquet(f"{out}/weights")
    n, v = stored.agg(F.count("*"), F.count_distinct("source_id")).first()
    write_metadata(spark, {"scores": scores.count(), "variants": v, "weights": n}, f"{out}/metadata", REFUSE)
    log.event("complete", scores=scores.count(), variants=v, weights=n)


def compile_score_fragment(spark: SparkSession, manifest: str, index_path: str, out: str, *, support_path: str | None = None, minimum: float = 0.0, progress: Progress | None = None) -> None:
    if not 0 <= minimum <= 1:
        raise InputError("the minimum fraction must be between 0 and 1")
    if minimum and not support_path:
        raise InputError("a minimum fraction needs a support index")
    log = progress or Progress("fragment")
    log.event("start")
    lineage = same_lineage(spark, index_path, *([support_path] if support_path else []))
    index, aliases = index_of(spark, index_path)
    support = spark.read.parquet(f"{support_path}/states") if support_path else None
    scores = inputs.read_manifest(spark, manifest, "fragment")
    block = meta_of(spark, index_path)["block_size"]
    rows, qc = fr.compile_fragment(inputs.read_weights(spark, scores), aliases, index, support, minimum, block)
    ids = F.broadcast(scores.select("score_idx", "score_id", "column_name", "path"))
    fr.laid_out(rows.join(ids.select("score_idx", "score_id"), "score_idx")).write.mode(REFUSE).partitionBy("tile_idx").parquet(f"{out}/rows")
    ids.join(qc, "score_idx", "left").orderBy("score_idx").write.mode(REFUSE).parquet(f"{out}/quality")
    sums = F.col("reference_supported_weights") + F.col("reference_missing_variant_weights") + F.col("reference_missing_frequency_weights")
    require_empty(quality_of(spark, out).where(sums != F.col("catalog_weights")).select("score_id", "catalog_weights"), "weight counts do not add up")
    stored = rows_of(spark, out)
    fr.variant_bits(stored).write.mode(REFUSE).parquet(f"{out}/bits")
    write_metadata(spark, {"signature": lineage, "weights": stored.count(), "minimum_fraction": minimum}, f"{out}/metadata", REFUSE)
    log.event("complete")


def write_quality(spark: SparkSession, fragment: str, out: str) -> None:
    """The quality table as text: all scores, the excluded ones too."""
    q = quality_of(spark, fragment).drop("score_idx")
    write_table(q.toDF(*(c.upper() for c in q.columns)), out, REFUSE)


def merge_variant_bits(spark: SparkSession, listing: str, out: str) -> int:
    paths = inputs.read_bitset_list(spark, listing)
    lineage = same_lineage(spark, *paths)
    fr.merge_bits([spark.read.parquet(f"{p}/bits") for p in paths]).write.mode(REFUSE).parquet(f"{out}/bits")
    write_metadata(spark, {"signature": lineage}, f"{out}/metadata", REFUSE)
    return spark.read.parquet(f"{out}/bits").count()


def report_fragment_support(spark: SparkSession, fragment: str, support_path: str, out: str) -> DataFrame:
    same_lineage(spark, fragment, support_path)
    found = fr.availability(rows_of(spark, fragment), spark.read.parquet(f"{support_path}/states"))
    names = eligible_scores(spark, fragment).select("score_idx", "score_id", "column_name")
    masses = quality_of(spark, fragment).select("score_idx", "reference_supported_weights", "reference_supported_weight_l1", "reference_supported_weight_l2_squared")
    met = names.join(found, "score_idx", "left").na.fill(0).join(masses, "score_idx")
    apart = lambda a, b: F.abs(F.col(a) - F.col(b)) > 1e-10 * F.greatest(F.lit(1.0), F.abs(F.col(b)))
    differ = (F.col("reference_weight_count") != F.col("reference_supported_weights")) | apart("reference_abs_weight", "reference_supported_weight_l1") | apart("reference_squared_weight", "reference_supported_weight_l2_squared")
    require_empty(met.where(differ).select("score_id", "reference_weight_count", "reference_supported_weights"), "stored rows and stored sums of a score differ")
    report = names.join(found, "score_idx", "left").na.fill(0).drop("score_idx")
    write_table(report.toDF(*(c.upper() for c in report.columns)), out, REFUSE)
    return report


def convert_to_parquet(spark: SparkSession, scored: str, out: str) -> None:
    """A score-major result, Parquet or binary, to the wide Parquet form."""
    form = meta_of(spark, scored).get("output_format")
    if form == "binary":
        cells, samples, columns, _ = read_matrix(spark, f"{scored}/scores")
        scores = cells.select(F.col("column").alias("score_idx"), F.col("row").alias("sample_idx"), "score")
        samples = samples.toDF(*(c.lower() for c in samples.columns)).withColumnRenamed("row", "sample_idx")
        if "fid" not in samples.columns:
            samples = samples.withColumn("fid", F.lit(None).cast("string"))
        names = list(enumerate(columns))
    elif form == "score-major":
        scores, samples, meta = (spark.read.parquet(f"{scored}/{t}") for t in ("scores", "samples", "score_metadata"))
        names = [(r["score_idx"], r["column_name"]) for r in meta.select("score_idx", "column_name").orderBy("score_idx").collect()]
    else:
        raise InputError(f"{scored} is no score-major result")
    if len({n for _, n in names}) < len(names):
        raise InputError("score names are not unique")
    write_wide_parquet(scoring.arrays(scores, [k for k, _ in names], samples), out, [n for _, n in names], REFUSE)
