"""Registered queries that go through files: tables are written as tab-separated text into the shared checkpoint folder and read back.

Row numbers of the readers, header rules, sinks and refusals are compared with SQL over the tables that were written.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.shared import new_folder, stored as stored_table
from additiva.functions.values import tile_of
from additiva.operators import fragments, frequency, scoring, stored
from additiva.operators.checks import InputError
from additiva.operators.support import USABLE
from additiva.operators.variants import aliases_of, build_index, locate
from additiva.operators.weights import compile_catalog
from additiva.plans import commands
from additiva.plans.score import MASSES, METADATA
from additiva.queries.registry import OMIT_SQL, PLAIN, QC_SQL, flagship, ordinal_edges, query
from additiva.queries.stars import BLOCK, N_SCORES, Domain
from additiva.sinks import matrix, writers
from additiva.sources import inputs, pgen, text


#: Cases of ``refusals`` that run at once.
CASES = 4


def folder(spark: SparkSession) -> str:
    return new_folder(spark, "files")


def put(df: DataFrame, order: str, header: str, path: str) -> str:
    """Writes the string columns of ``df`` in order as part files, each with the header; gives the folder."""
    columns = [c for c in df.columns if c != order]
    rows = df.select(F.col(order).cast("long").alias("at"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = header.split("\n")
        for b in batches:
            if b.num_rows:
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.string())], names=["value"])
                    first = []
                yield pa.RecordBatch.from_arrays(b.columns, names=["value"])

    if rows.isEmpty():
        listed(df.sparkSession, header.split("\n"), path)
        return path
    rows.repartitionByRange("at").sortWithinPartitions("at").select("value").mapInArrow(headed, "value string").write.text(path)
    return path


def listed(spark: SparkSession, lines: list[str], path: str) -> str:
    """A short list of files, as one file."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).select("_metadata.file_path").first()[0]


@query("SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, source_id, target_id, ref, alt FROM variants")
def text_variant_list(d: Domain) -> DataFrame:
    """Variant list: named columns in any order, with one that nobody asked for."""
    rows = d.variant_list.select("ordinal", "alt", "p_size", "ref", "target_id", "source_id")
    return inputs.read_variant_list(d.spark, put(rows, "ordinal", "ALT\tEXTRA\tREF\tTARGET_ID\tSOURCE_ID", folder(d.spark)))


@query("SELECT row_number() OVER (ORDER BY ordinal) - 1 AS pgen_variant_idx, '1' AS chrom, target_id AS id, ref, alt FROM variants WHERE p_size <> 7 QUALIFY ordinal % 2 = 0")
def text_pvar_filtered(d: Domain) -> DataFrame:
    """PVAR limited to some IDs: rows keep their number in the file."""
    rows = d.pvar.select("pgen_variant_idx", "chrom", F.lit("7").alias("pos"), "id", "ref", "alt")
    path = put(rows, "pgen_variant_idx", "##meta\n#CHROM\tPOS\tID\tREF\tALT", folder(d.spark))
    return inputs.read_pvar(d.spark, path, d.variant_list.where("ordinal % 2 = 0").select(F.col("target_id").alias("id")))


@query("SELECT row_number() OVER (ORDER BY ordinal) - 1 AS pgen_variant_idx, target_id AS id, ref, alt FROM variants WHERE p_size <> 7")
def text_pvar_indexed(d: Domain) -> DataFrame:
    return inputs.read_indexed_pvar(d.spark, put(d.pvar.select("pgen_variant_idx", "id", "ref", "alt"), "pgen_variant_idx", "ID\tREF\tALT", folder(d.spark)))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS sample_idx, CAST(c_nationkey AS VARCHAR) AS fid, CAST(c_custkey AS VARCHAR) AS iid FROM customer")
def text_psam(d: Domain) -> DataFrame:
    return inputs.read_psam(d.spark, put(d.samples, "sample_idx", "#FID\tIID", folder(d.spark)))


@query("SELECT source_id, target_id FROM variants")
def text_variant_map(d: Domain) -> DataFrame:
    return inputs.read_variant_map(d.spark, put(d.variant_list.select("ordinal", "source_id", "target_id"), "ordinal", "SOURCE_ID\tTARGET_ID", folder(d.spark)))


def weight_files(d: Domain, base: str) -> str:
    """The weights of each score as a folder of part files, all written by one job in ranges of (score, row); gives the manifest."""
    first = ["snp", "effect", "other", "weight"], "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT"
    second = ["weight", "other", "snp", "effect"], "EFFECT_ALLELE_WEIGHT\tOTHER_ALLELE\tSNP\tEFFECT_ALLELE"
    line = lambda columns: F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = d.weights.select(F.col("score_idx").cast("long").alias("score"), F.col("row_seq").cast("long").alias("at"), F.when(F.col("score_idx") % 2 == 0, line(first[0])).otherwise(line(second[0])).alias("value"))
    headers = {k: (first if k % 2 == 0 else second)[1] for k in range(N_SCORES)}

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's part of a score begins with the header: the sort puts it before all rows.
        seen: set[int] = set()
        for b in batches:
            new = sorted(set(pc.unique(b.column(0)).to_pylist()) - seen)
            seen.update(new)
            yield pa.RecordBatch.from_arrays(b.columns, names=["score", "at", "value"])
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([-(1 << 63)] * len(new), pa.int64()), pa.array([headers[k] for k in new], pa.string())], names=["score", "at", "value"])

    ordered = rows.repartitionByRange("score", "at").mapInArrow(headed, "score long, at long, value string").sortWithinPartitions("score", "at")
    ordered.select("score", "value").write.partitionBy("score").text(f"{base}/files")
    found = {r[0] for r in d.weights.select("score_idx").distinct().collect()}
    paths = [f"{base}/files/score={k}" if k in found else listed(d.spark, [headers[k]], f"{base}/{k}") for k in range(N_SCORES)]
    return listed(d.spark, ["SCORE\tPATH", *(f"score{k}\t{p}" for k, p in enumerate(paths))], f"{base}/manifest")


def command_run(d: Domain) -> str:
    """The command ``score`` over files of all tables under the policy ``omit``, with the binary matrix as output; gives its folder."""
    base = folder(d.spark)
    d.calls.select("id", "sample_idx", "dosage").write.parquet(f"{base}/calls")
    pvar = put(d.pvar.select("pgen_variant_idx", "chrom", "id", "ref", "alt"), "pgen_variant_idx", "#CHROM\tID\tREF\tALT", f"{base}/pvar")
    psam = put(d.samples, "sample_idx", "#FID\tIID", f"{base}/psam")
    freq = put(d.frequencies.join(d.variant_list.select("ordinal", F.col("target_id").alias("id")), "id").select("ordinal", "id", "ref", "alt", "alt_dosage_mean"), "ordinal", "ID\tREF\tALT\tALT_DOSAGE_MEAN", f"{base}/freq")
    commands.score(d.spark, f"{base}/out", [{"PGEN": f"{base}/calls", "PVAR": pvar, "PSAM": psam}], manifest=weight_files(d, f"{base}/weights"), frequency_path=freq, policy="omit", form="binary")
    return f"{base}/out"


@query(QC_SQL + """
, f AS (SELECT score_idx, count_if(weight <> 0 AND p_size < 5) AS missing_frequencies, sum(CASE WHEN weight <> 0 AND p_size <> 7 AND p_size >= 5 AND ref_effect THEN 2 * weight ELSE 0 END) AS intercept FROM w GROUP BY score_idx)
SELECT CAST(s.score_idx AS INTEGER) AS index, 'score' || s.score_idx AS score, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in "input_weights zero_weights excluded_weights duplicate_weights catalog_weights matched_weights missing_variants missing_frequencies alt_effects ref_effects".split()) + """,
  CAST(coalesce(matched_weights - missing_frequencies, 0) AS BIGINT) AS scored_weights, CAST(coalesce(intercept, 0) AS DOUBLE) AS ref_intercept, """ + ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in MASSES) + """
FROM scores s LEFT JOIN qc USING (score_idx) LEFT JOIN f USING (score_idx)
""")
def score_command_metadata(d: Domain) -> DataFrame:
    """The 20 metadata columns that the command writes."""
    return d.spark.read.parquet(f"{command_run(d)}/score_metadata").select(*METADATA)


@query(OMIT_SQL + "SELECT CAST(c_nationkey AS VARCHAR) AS FID, CAST(c_custkey AS VARCHAR) AS IID, " + ", ".join(f"max(CASE WHEN score_idx = {k} THEN score END) AS score{k}" for k in range(N_SCORES)) + " FROM customer JOIN result ON c_custkey = sample_idx GROUP BY ALL")
def score_command_converted(d: Domain) -> DataFrame:
    """The command's binary matrix, converted to wide Parquet and read back."""
    out = command_run(d)
    commands.convert_to_parquet(d.spark, out, f"{out}/wide")
    return d.spark.read.parquet(f"{out}/wide")


@query("SELECT score_idx, snp, CASE WHEN ref_effect THEN ref ELSE alt END AS effect, CASE WHEN ref_effect THEN alt ELSE ref END AS other, CAST(weight AS DOUBLE) AS weight FROM weights JOIN variants USING (ordinal)")
def text_weights(d: Domain) -> DataFrame:
    """Sixteen weight files and their manifest, read as one table; every other file has its columns in another order."""
    manifest = inputs.read_manifest(d.spark, weight_files(d, folder(d.spark)))
    return inputs.read_weights(d.spark, manifest).select(F.col("score_idx").cast("long").alias("score_idx"), "snp", "effect", "other", "weight")


@query("SELECT target_id AS id, ref, alt, p_size / 32.0 AS alt_dosage_mean FROM variants WHERE p_size >= 5")
def text_frequencies(d: Domain) -> DataFrame:
    rows = d.variant_list.select("ordinal", "target_id", "ref", "alt", F.when(F.col("p_size") >= 5, (F.col("p_size") / 32.0).cast("string")).otherwise("NA").alias("mean"))
    return frequency.read_frequencies(d.spark, put(rows, "ordinal", "#id\tref\talt\talt_dosage_mean", folder(d.spark)))


@query("SELECT ordinal, p_size / 32.0 AS alt_dosage_mean FROM variants WHERE p_size >= 5")
def text_frequencies_indexed(d: Domain) -> DataFrame:
    rows = d.variant_list.where("p_size >= 5").select("ordinal", F.when(F.col("ordinal") % 2 == 0, F.col("source_id")).otherwise(F.col("target_id")).alias("id"), "ref", "alt", (F.col("p_size") / 64.0).cast("string").alias("freq"))
    return frequency.indexed(frequency.read_frequencies(d.spark, put(rows, "ordinal", "ID\tREF\tALT\tALT_FREQS", folder(d.spark))), d.aliases, d.index)


@query(OMIT_SQL + "SELECT CAST(c_nationkey AS VARCHAR) AS fid, CAST(c_custkey AS VARCHAR) AS iid, max(CASE WHEN score_idx = 0 THEN score END) AS a, max(CASE WHEN score_idx = 1 THEN score END) AS b FROM customer JOIN result ON c_custkey = sample_idx GROUP BY ALL")
def sink_wide_text(d: Domain) -> DataFrame:
    """Two scores as gzip-compressed wide text, read back as numbers: 17 digits keep every double."""
    path = folder(d.spark)
    writers.write_wide_text(scoring.arrays(flagship(d).where("score_idx < 2"), [0, 1], d.samples), path, ["a", "b"])
    files = [r[0] for r in d.spark.read.text(path).select("_metadata.file_path").distinct().collect()]
    back = text.read_tables(d.spark, files, ["FID", "IID", "a", "b"])
    return back.select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


@query(OMIT_SQL + PLAIN)
def sink_score_major(d: Domain) -> DataFrame:
    path = folder(d.spark)
    writers.write_score_major(flagship(d), path)
    return d.spark.read.parquet(path)


@query(OMIT_SQL + "SELECT CAST(c_custkey AS VARCHAR) AS IID, CAST(c_nationkey AS VARCHAR) AS FID, max(CASE WHEN score_idx = 3 THEN score END) AS third FROM customer JOIN result ON c_custkey = sample_idx GROUP BY ALL")
def sink_wide_parquet(d: Domain) -> DataFrame:
    path = folder(d.spark)
    writers.write_wide_parquet(scoring.arrays(flagship(d).where("score_idx = 3"), [3], d.samples), path, ["third"])
    return d.spark.read.parquet(path)


@query(OMIT_SQL + PLAIN)
def sink_score_major_bytes(d: Domain) -> DataFrame:
    """The matrix as little-endian doubles in part files, read back by byte ranges and named again."""
    path = folder(d.spark)
    matrix.write_matrix(flagship(d), [(k, f"score{k}") for k in range(N_SCORES)], d.samples, path)
    cells, samples, names, _ = matrix.read_matrix(d.spark, path, range_bytes=1 << 20)
    order = d.spark.createDataFrame([(k, int(n.removeprefix("score"))) for k, n in enumerate(names)], "column long, score_idx long")
    return cells.join(F.broadcast(order), "column").join(samples.select("row", F.col("IID").cast("long").alias("sample_idx")), "row").select("score_idx", "sample_idx", "score")


def containers(d: Domain) -> tuple[DataFrame, int]:
    """All calls written as container shards by tasks and read back in sparse form, with the number of samples. Records list
    the samples that differ, so files and work grow with the calls, not with variants times samples; shards follow the lines, and a
    shard is read by one task, so that a task's rows and the driver's share of each stay the same."""
    n, path = d.samples.count(), folder(d.spark)
    calls = d.calls.select(F.col("ordinal").alias("pgen_variant_idx"), "sample_idx", "dosage")
    pgen.write_pgen(calls, d.variant_list.select(F.col("ordinal").alias("pgen_variant_idx")), n, path, pgen.VARIABLE, d.parts)
    if pgen.counts_of(path) != (d.variant_list.count(), n):
        raise InputError("variant or sample counts differ")
    return pgen.read_pgen(d.spark, path), n


@query("SELECT ordinal, c_custkey AS sample_idx, CAST(dosage AS DOUBLE) AS dosage FROM calls JOIN customer ON c_custkey = sample_idx WHERE dosage IS NULL OR dosage <> 0")
def pgen_calls(d: Domain) -> DataFrame:
    """Exceptions from the common dosage, which is 0 as most samples are not listed."""
    usual, _ = pgen.calls_and_common(containers(d)[0].where("common = 0"))
    return usual.select(F.col("pgen_variant_idx").alias("ordinal"), "sample_idx", "dosage")


@query(OMIT_SQL + PLAIN)
def score_pgen(d: Domain) -> DataFrame:
    """Scores of a cohort in containers: common dosages from the reader, exceptions joined."""
    # Calls are used once and common dosages twice, but containers are read once.
    calls, common = pgen.calls_and_common(stored_table(containers(d)[0]))
    ordinal = F.col("pgen_variant_idx").alias("ordinal")
    return scoring.evaluate(ordinal_edges(d), calls.select(ordinal, "sample_idx", "dosage"), d.samples, d.scores, common.select(ordinal, "common"), "ordinal", d.parts)


def refusal_cases(d: Domain) -> dict:
    """Whole tables with a fault each, most in one row, and what must refuse them."""
    spark, base, v = d.spark, folder(d.spark), d.variant_list
    last = F.col("ordinal") == v.agg(F.max("ordinal")).first()[0]
    faulty = lambda good, bad: F.when(last, bad).otherwise(good)
    mapped = lambda n, source, target: put(v.select("ordinal", source.alias("s"), target.alias("t")), "ordinal", "SOURCE_ID\tTARGET_ID", f"{base}/{n}")
    freq = lambda n, value, alt=F.col("alt"): frequency.read_frequencies(spark, put(v.select("ordinal", "target_id", "ref", alt.alias("a"), value.alias("f")), "ordinal", "ID\tREF\tALT\tALT_FREQS", f"{base}/{n}"))
    share = (F.col("p_size") / 64.0).cast("string")

    def weights_of(n: str, value: Column) -> None:
        rows = d.weights.select("row_seq", "snp", "effect", "other", value.alias("w"))
        path = put(rows, "row_seq", "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT", f"{base}/{n}")
        inputs.read_weights(spark, inputs.read_manifest(spark, listed(spark, ["SCORE\tPATH", f"s\t{path}"], f"{base}/m{n}")))

    def list_of(n: str, *columns: Column) -> None:
        lines = v.select("ordinal", F.concat_ws("\t", *columns).alias("line"))
        inputs.read_variant_list(spark, put(lines, "ordinal", "SOURCE_ID\tTARGET_ID\tREF\tALT", f"{base}/{n}"))

    short = F.when(~last, F.col("alt"))
    return {
        "blank_map_id": lambda n: inputs.read_variant_map(spark, mapped(n, F.col("source_id"), faulty(F.col("target_id"), ""))),
        "map_source_twice": lambda n: inputs.read_variant_map(spark, mapped(n, faulty(F.col("source_id"), "s0"), F.col("target_id"))),
        "map_target_twice": lambda n: inputs.read_variant_map(spark, mapped(n, F.col("source_id"), faulty(F.col("target_id"), "v0"))),
        "frequency_multiallelic": lambda n: freq(n, share, faulty(F.col("alt"), "C,G")),
        "frequency_named_missing": lambda n: freq(n, faulty(share, F.concat("alt", F.lit("=NA")))),
        "frequency_outside": lambda n: freq(n, faulty(share, "1.5")),
        "frequency_not_a_number": lambda n: freq(n, faulty(share, "1d")),
        "short_row": lambda n: list_of(n, F.col("source_id"), F.col("target_id"), F.col("ref"), short),
        "weight_not_a_number": lambda n: weights_of(n, F.when(F.col("row_seq") % 1000 == 1, "much").otherwise(F.col("weight").cast("string"))),
        "index_equal_alleles": lambda n: build_index(v.drop("p_size").withColumn("alt", faulty(F.col("alt"), F.col("ref"))), block=BLOCK),
        "index_blank_field": lambda n: build_index(v.drop("p_size").withColumn("source_id", faulty(F.col("source_id"), "")), block=BLOCK),
        "alias_of_two_variants": lambda n: aliases_of(build_index(v.drop("p_size").withColumn("target_id", faulty(F.col("target_id"), "s0")), block=BLOCK)),
        "index_alleles_swapped": lambda n: locate(d.pvar.select("pgen_variant_idx", "id", F.col("alt").alias("ref"), F.col("ref").alias("alt")), d.aliases, d.index),
        "pvar_variant_twice": lambda n: locate(d.pvar.unionByName(d.pvar.limit(1)), d.aliases, d.index),
        "no_frequency": lambda n: scoring.with_means(d.edges, d.frequencies, None, "error"),
        "weights_of_two_pairs": lambda n: compile_catalog(d.weights.withColumn("other", F.when(F.col("row_seq") % 1000 == 1, "N").otherwise(F.col("other")))),
        "all_fit": lambda n: inputs.read_variant_map(spark, mapped(n, F.col("source_id"), F.col("target_id"))),
    }


REFUSALS = "alias_of_two_variants blank_map_id frequency_multiallelic frequency_named_missing frequency_not_a_number frequency_outside index_alleles_swapped index_blank_field index_equal_alleles map_source_twice map_target_twice no_frequency pvar_variant_twice short_row weight_not_a_number weights_of_two_pairs".split()


@query("SELECT name, (SELECT count(*) FROM variants) > 1 AND (SELECT count(*) FROM weights) > 0 AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in REFUSALS) + ") v(name) UNION ALL SELECT 'all_fit', false")
def refusals(d: Domain) -> DataFrame:
    """Whole tables with a fault must end in an error, the last one without a fault must not. The cases are separate jobs and run side by side."""

    def refused(case: tuple) -> tuple[str, bool]:
        name, action = case
        try:
            action(name)
        except InputError:
            return name, True
        return name, False

    with ThreadPoolExecutor(CASES) as pool:
        found = list(pool.map(refused, refusal_cases(d).items()))
    return d.spark.createDataFrame(found, "name string, refused boolean")


@query(OMIT_SQL + PLAIN)
def score_stored_tiles(d: Domain) -> DataFrame:
    """Index, support and fragment compiled and stored; fragment and genotypes read back by the tiles that the target supports, and scored."""
    base, spark = folder(d.spark), d.spark
    tile = tile_of(F.col("ordinal"), BLOCK).alias("tile_idx")
    d.support.select("ordinal", "state", tile).write.parquet(f"{base}/support")
    stored.store_by_tile(d.fragment()[0], f"{base}/rows", d.parts)
    stored.store_by_tile(d.calls_by("ordinal").select("ordinal", "sample_idx", F.col("dosage").cast("double").alias("dosage"), tile), f"{base}/calls", d.parts)
    tiles = stored.tiles_of(spark.read.parquet(f"{base}/support"), F.col("state") == USABLE)
    rows = stored.in_tiles(spark, f"{base}/rows", "score_idx long, ordinal long, row_seq long, weight double, ref_effect boolean", tiles)
    calls = stored.in_tiles(spark, f"{base}/calls", "ordinal long, sample_idx long, dosage double", tiles)
    means = d.variant_list.where("p_size >= 5").select("ordinal", (F.col("p_size") / 32.0).alias("alt_dosage_mean"))
    return scoring.evaluate(scoring.with_means(fragments.edges_of(rows), means, None, "omit", "ordinal"), calls, d.samples, d.scores, key="ordinal", parts=d.parts)


@query(OMIT_SQL + PLAIN)
def score_bucketed(d: Domain) -> DataFrame:
    """Edges and calls stored in buckets of variants, joined without a shuffle. Buckets follow the lines, so that a task's does not grow."""
    base, n = folder(d.spark), max(8, d.parts)
    edges = stored.store_in_buckets(scoring.combined(scoring.dealt(ordinal_edges(d), n, "ordinal"), "ordinal"), f"{base}/edges", "ordinal", n)
    calls = stored.store_in_buckets(d.calls_by("ordinal").select("ordinal", "sample_idx", "dosage"), f"{base}/calls", "ordinal", n)
    return scoring.total(scoring.baselines(edges, d.scores, None, "ordinal"), d.scores, d.samples, edges, calls, "ordinal", parts=n)
