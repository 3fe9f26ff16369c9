"""The command ``score``: each input is read once.

Text inputs are parsed into Parquet tables in the shared folder, with their rules inside that scan (``checks.checked``); the genotypes
pass once through a scan that checks them, keeps the calls of scored variants and counts, and later steps (cohort means, the
product) read the kept calls. Run counters are observed in these passes (``DataFrame.observe``), not counted by jobs of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from additiva.functions.shared import stored
from additiva.operators import fragments as fr
from additiva.operators import frequency, scoring, weights
from additiva.operators.checks import InputError, as_input_errors, checked, require_empty, require_same, require_unique
from additiva.operators.variants import locate
from additiva.plans.artefacts import eligible_scores, index_of, rows_of, same_lineage
from additiva.sinks.matrix import write_matrix
from additiva.sinks.writers import OVERWRITE, Progress, write_metadata, write_score_major, write_table, write_wide_parquet, write_wide_text
from additiva.sources import inputs
from additiva.sources.genotypes import header_counts, read_genotypes

FORMS = ("wide", "parquet", "score-major", "binary")
#: Columns of the score metadata, in order.
METADATA = (
    "index score input_weights zero_weights excluded_weights duplicate_weights catalog_weights matched_weights missing_variants missing_frequencies scored_weights alt_effects ref_effects "
    "nonzero_weight_l1 nonzero_weight_l2_squared catalog_weight_l1 catalog_weight_l2_squared reference_supported_weight_l1 reference_supported_weight_l2_squared ref_intercept"
).split()
MASSES = METADATA[13:19]


@dataclass
class Bound:
    """What a score source gives: rows (score_idx, key, beta, intercept, ref_effect) of matched weights, the scores, counts by
    score known so far, the places (input_idx, pgen_variant_idx, key) of its variants, and frequencies by key."""

    edges: DataFrame
    names: DataFrame
    counts: DataFrame
    places: DataFrame
    frequencies: DataFrame | None
    key: str


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (p.withColumn("input_idx", F.lit(k)) for k, p in enumerate(parts)))


def read_cohort(spark: SparkSession, filesets: list[dict[str, str]], indexed: bool) -> tuple[DataFrame, int, DataFrame, dict[int, int]]:
    """(samples, their number, PVAR rows with input_idx, PVAR rows of each input) of shards of one cohort."""
    samples = stored(inputs.read_psam(spark, filesets[0]["PSAM"]))
    for f in filesets[1:]:
        require_same(samples, inputs.read_psam(spark, f["PSAM"]), "sample_idx", ["fid", "iid"], "samples differ between filesets")
    read = inputs.read_indexed_pvar if indexed else inputs.read_pvar
    pvar = stored(_union([read(spark, f["PVAR"], fused=True) for f in filesets]))
    rows = {r["input_idx"]: r["n"] for r in pvar.groupBy("input_idx").agg(F.count("*").alias("n")).collect()}
    return samples, samples.count(), pvar, rows


def genotypes_of(spark: SparkSession, filesets: list[dict[str, str]], pvar: DataFrame, n_samples: int, n_rows: dict[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """(calls, common dosages) with input_idx and pgen_variant_idx. A call outside the PVAR or PSAM is an error when it is read; a
    container's own counts are compared before."""
    calls, common = [], []
    for k, f in enumerate(filesets):
        counts = header_counts(f["PGEN"], n_samples)
        if counts and counts != (n_rows.get(k, 0), n_samples):
            raise InputError(f"{f['PGEN']} has {counts[0]} variants and {counts[1]} samples, its PVAR {n_rows.get(k, 0)} and its PSAM {n_samples}")
        found, usual = read_genotypes(spark, f["PGEN"], n_samples)
        if "pgen_variant_idx" not in found.columns:
            found = found.join(pvar.where(F.col("input_idx") == k).select("id", "pgen_variant_idx"), "id")
        at, who = F.col("pgen_variant_idx"), F.col("sample_idx")
        at = checked(at, (at < 0) | (at >= n_rows.get(k, 0)), "genotypes of a variant that the PVAR lacks", at, who)
        at = checked(at, who.isNull() | (who < 0) | (who >= n_samples), "genotypes of a sample that the PSAM lacks", F.col("pgen_variant_idx"), who)
        calls.append(found.select(at.cast("long").alias("pgen_variant_idx"), who.cast("long").alias("sample_idx"), F.col("dosage").cast("double").alias("dosage"), F.lit(k).alias("input_idx")))
        if usual is not None:
            common.append(usual.withColumn("input_idx", F.lit(k)))
    return reduce(DataFrame.unionByName, calls), reduce(DataFrame.unionByName, common) if common else None


def bound_catalog(spark: SparkSession, pvar: DataFrame, manifest: str | None, catalog: str | None, frequency_path: str | None, variant_map: str | None) -> Bound:
    if catalog is not None:
        rows, counts, scores = (spark.read.parquet(f"{catalog}/{t}") for t in ("weights", "counts", "scores"))
    else:
        scores = inputs.read_manifest(spark, manifest)
        flagged = stored(weights.fused_checks(weights.flag_weights(inputs.read_weights(spark, scores, fused=True))))
        kept = flagged.where(~F.col("is_zero") & ~F.col("is_excluded"))
        weights.check_pairs(kept)
        rows, counts = weights.catalog_rows(kept), weights.catalog_counts(flagged)
    mapped = stored(inputs.read_variant_map(spark, variant_map)) if variant_map else None
    ids = rows.select("source_id").distinct()
    ids = ids.join(mapped, "source_id").select(F.col("target_id").alias("id")) if mapped is not None else ids.select(F.col("source_id").alias("id"))
    scored = stored(pvar.join(ids, "id", "left_semi").where("id NOT IN ('', '.')"))
    require_unique(scored, ["id"], "ID in two PVAR rows")
    bound = stored(weights.bind(rows, scored, mapped, validate=False, fused=True))
    frequencies = None
    if frequency_path:
        alleles = scored.select("id", F.col("ref").alias("v_ref"), F.col("alt").alias("v_alt"))
        frequencies = frequency.read_frequencies(spark, frequency_path, scored.select("id"), once=True).join(alleles, "id")
        differ = (F.col("ref") != F.col("v_ref")) | (F.col("alt") != F.col("v_alt"))
        shown = [F.col(c) for c in ("id", "ref", "alt", "v_ref", "v_alt")]
        frequencies = frequencies.select("id", checked(F.col("alt_dosage_mean"), differ, "frequency alleles disagree with the PVAR", *shown).alias("alt_dosage_mean"))
    counts = counts.join(weights.bound_counts(bound).drop("ref_intercept"), "score_idx", "left")
    for c in MASSES:
        counts = counts.withColumn(c, F.lit(0.0))
    edges = bound.where("status = 'matched'").select("score_idx", "id", "beta", "intercept", "ref_effect")
    return Bound(edges, scores.select("score_idx", "column_name"), counts, scored.select("input_idx", "pgen_variant_idx", "id"), frequencies, "id")


def bound_fragments(spark: SparkSession, pvar: DataFrame, fragment_list: str, index_path: str, frequency_path: str | None, score_schema: str | None) -> Bound:
    paths = inputs.read_fragment_list(spark, fragment_list)
    same_lineage(spark, index_path, *paths)
    index, aliases = index_of(spark, index_path)
    schema = inputs.read_score_schema(spark, score_schema) if score_schema else None
    located = stored(locate(pvar, aliases, index))
    found = [eligible_scores(spark, p) for p in paths]
    rows, names = fr.merge_fragments([(rows_of(spark, p), q.select("score_id", "column_name")) for p, q in zip(paths, found, strict=True)], schema)
    here = located.select("ordinal", F.lit(True).alias("here"))
    met = stored(rows.join(here, "ordinal", "left"))
    frequencies = frequency.indexed(frequency.read_frequencies(spark, frequency_path, once=True), aliases, index) if frequency_path else None
    there = F.col("here").isNotNull()
    sums = met.groupBy("score_idx").agg(
        F.count_if(there).alias("matched_weights"), F.count_if(~there).alias("absent"), F.count_if(there & ~F.col("ref_effect")).alias("alt_effects"), F.count_if(there & F.col("ref_effect")).alias("ref_effects")
    )
    quality = reduce(DataFrame.unionByName, (q.drop("score_idx", "column_name") for q in found))
    counts = names.select("score_idx", "score_id").join(quality, "score_id").join(sums, "score_idx", "left").na.fill(0)
    counts = counts.withColumn("missing_variants", F.col("reference_missing_variant_weights") + F.col("absent")).withColumn("missing_before", F.col("reference_missing_frequency_weights"))
    w, r = F.col("weight"), F.col("ref_effect")
    edges = met.where(there).select("score_idx", "ordinal", F.when(r, -w).otherwise(w).alias("beta"), F.when(r, 2 * w).otherwise(F.lit(0.0)).alias("intercept"), "ref_effect")
    return Bound(edges, names.select("score_idx", "column_name"), counts, located, frequencies, "ordinal")


def with_frequencies(b: Bound, policy: str, seen: Observation) -> DataFrame:
    """The edges with their frequency or null, stored; counts observed."""
    key = b.key
    if b.frequencies is None:
        edges = b.edges.withColumn("alt_dosage_mean", F.lit(None).cast("double"))
    else:
        edges = b.edges.join(b.frequencies.select(key, "alt_dosage_mean"), key, "left")
        if policy == "error":
            edges = edges.withColumn("beta", checked(F.col("beta"), F.col("alt_dosage_mean").isNull(), "no frequency row for scored variant", F.col(key)))
    return stored(edges.observe(seen, F.count(F.lit(1)).alias("edges"), F.count_if(F.col("alt_dosage_mean").isNull()).alias("unknown")))


def score_metadata(b: Bound, edges: DataFrame, policy: str) -> DataFrame:
    """One row a score with the columns of ``METADATA`` and its column's name."""
    unknown = F.col("alt_dosage_mean").isNull() if policy == "omit" else F.lit(False)
    last = edges.groupBy("score_idx").agg(F.count_if(unknown).alias("omitted"), F.coalesce(F.sum(F.when(~unknown, F.col("intercept"))), F.lit(0.0)).alias("ref_intercept"))
    rows = b.names.join(b.counts.drop("column_name", "ref_intercept"), "score_idx", "left").join(last, "score_idx", "left").na.fill(0)
    before = F.col("missing_before") if "missing_before" in rows.columns else F.lit(0)
    rows = rows.withColumn("missing_frequencies", (before + F.col("omitted")).cast("long")).withColumn("scored_weights", F.col("matched_weights") - F.col("omitted"))
    return rows.withColumn("index", F.col("score_idx")).withColumn("score", F.col("column_name")).select("score_idx", "column_name", *METADATA)


def check_counts(metadata: DataFrame) -> None:
    """Every retained weight row is matched, or misses its variant or its frequency."""
    kept = F.col("matched_weights") + F.col("missing_variants") + F.col("missing_frequencies") - (F.col("matched_weights") - F.col("scored_weights"))
    require_empty(metadata.where(kept != F.col("catalog_weights")).select("score", "catalog_weights", "matched_weights", "missing_variants", "missing_frequencies"), "weight counts do not add up")


def score(
    spark: SparkSession, out: str, filesets: list[dict[str, str]], *, manifest: str | None = None, catalog: str | None = None, fragment_list: str | None = None, index_path: str | None = None,
    frequency_path: str | None = None, variant_map: str | None = None, score_schema: str | None = None, policy: str = "cohort", form: str = "wide", progress: Progress | None = None,
) -> DataFrame:
    """Scores of a cohort from a manifest, a compiled catalog or compiled fragments; gives (score_idx, sample_idx, score)."""
    if sum(x is not None for x in (manifest, catalog, fragment_list)) != 1:
        raise InputError("give exactly one of manifest, catalog and fragment_list")
    if fragment_list is None and (index_path or score_schema):
        raise InputError("index and score schema need a fragment list")
    if fragment_list is not None and variant_map:
        raise InputError("fragments are matched by the index, not by a variant map")
    if fragment_list is not None and not index_path:
        raise InputError("a fragment list needs an index")
    if policy not in scoring.POLICIES or policy != "cohort" and not frequency_path:
        raise InputError(f"policy {policy} is unknown or needs frequencies")
    if form not in FORMS:
        raise InputError(f"unknown output form {form}")
    log = progress or Progress("score")
    log.event("start")
    log.event("pfile_inputs_loaded", files=len(filesets))
    with as_input_errors(), log.watching(spark, "running"):
        samples, n_samples, pvar, n_rows = read_cohort(spark, filesets, fragment_list is not None)
        log.event("samples_loaded", samples=n_samples)
        if fragment_list is not None:
            b = bound_fragments(spark, pvar, fragment_list, index_path, frequency_path, score_schema)
        else:
            b = bound_catalog(spark, pvar, manifest, catalog, frequency_path, variant_map)
        log.event("frequencies_loaded")
        key, weighed, varied, called = b.key, Observation(), Observation(), Observation()
        edges = with_frequencies(b, policy, weighed)
        used = edges.where("alt_dosage_mean IS NOT NULL") if policy == "omit" else edges
        known = F.count_if(F.col("mean").isNotNull())
        variants = stored(used.groupBy(key).agg(F.max("alt_dosage_mean").alias("mean")).observe(varied, F.count(F.lit(1)).alias("variants"), known.alias("known")))
        calls, common = genotypes_of(spark, filesets, pvar, n_samples, n_rows)
        places = b.places.join(variants.select(key), key, "left_semi").select("input_idx", "pgen_variant_idx", key)
        kept = calls.join(places, ["input_idx", "pgen_variant_idx"]).select(key, "sample_idx", "dosage")
        calls = stored(kept.observe(called, F.count(F.lit(1)).alias("calls"), F.count_if(F.col("dosage").isNull()).alias("missing")))
        unlisted = 0
        if common is not None:
            common = stored(common.join(places, ["input_idx", "pgen_variant_idx"]).select(key, "common"))
            listed = calls.groupBy(key).agg(F.count("*").alias("n"))
            unlisted = common.where("common IS NULL").join(listed, key, "left").agg(F.sum(n_samples - F.coalesce("n", F.lit(0)))).first()[0] or 0
        log.event("genotypes_loaded", calls=called.get["calls"])
        means = scoring.cohort_means(calls, n_samples, common, key)
        ready = used.join(means, key, "left").withColumn("mean", F.coalesce("alt_dosage_mean", "cohort_mean")).select("score_idx", key, "beta", "intercept", "mean") if policy == "cohort" else used.select("score_idx", key, "beta", "intercept", F.col("alt_dosage_mean").alias("mean"))
        if policy == "cohort":
            scoring.require_means(ready, calls, key)
        parts = scoring.parts_of(max(called.get["calls"], weighed.get["edges"]))
        scores = scoring.evaluate(ready, calls, samples, b.names.select("score_idx"), common, key, parts)
        ordered = [(r["score_idx"], r["column_name"]) for r in b.names.orderBy("score_idx").collect()]
        log.event("write_scores")
        names = [n for _, n in ordered]
        if form == "score-major":
            write_score_major(scores, f"{out}/scores")
        elif form == "binary":
            write_matrix(scores, ordered, samples, f"{out}/scores")
        else:
            (write_wide_text if form == "wide" else write_wide_parquet)(scoring.arrays(scores, [k for k, _ in ordered], samples), f"{out}/scores", names, OVERWRITE)
        samples.write.mode(OVERWRITE).parquet(f"{out}/samples")
        metadata = stored(score_metadata(b, edges, policy))
        check_counts(metadata)
        metadata.coalesce(1).write.mode(OVERWRITE).parquet(f"{out}/score_metadata")
        write_table(metadata.select(*METADATA).orderBy("index").toDF(*(c.upper() for c in METADATA)), f"{out}/score_metadata_text", OVERWRITE, 1)
        seen, vs, unknown = weighed.get, varied.get, weighed.get["unknown"]
        # Without a frequency file no variant misses a frequency: all have the cohort's.
        cohort, given = vs["variants"] - vs["known"], frequency_path is not None
        omitted = edges.where("alt_dosage_mean IS NULL").select(key).distinct().count() if policy == "omit" and unknown else 0
        run = {
            "scores": len(names), "samples": n_samples, "pgen_inputs": len(filesets), "pvar_variants_loaded": sum(n_rows.values()), "scored_variants": vs["variants"], "weight_edges": seen["edges"] - (unknown if policy == "omit" else 0),
            "imputed_values": called.get["missing"] + unlisted, "external_frequency_variants": vs["known"], "cohort_frequency_variants": cohort, "missing_frequency_variants": (cohort if given else 0) + omitted,
            "omitted_frequency_variants": omitted, "omitted_frequency_edges": unknown if policy == "omit" else 0, "missing_frequency_policy": policy, "output_format": form,
        }
        write_metadata(spark, run, f"{out}/metadata")
        log.event("scores_written", scores=len(names))
        log.event("complete", edges=run["weight_edges"], variants=run["scored_variants"], imputed_values=run["imputed_values"])
    return scores
