"""Registered queries: each applies one operator or command to whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from additiva.functions.shared import stored
from additiva.functions.values import fraction, tile_of
from additiva.operators import blocked, dense, fragments, frequency, scoring, support, variants, weights
from additiva.queries.stars import BLOCK, N_SCORES, SQL as STAR, Domain
from additiva.streaming.shards import score_stream_to_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"WITH {STAR.strip()}\n{sql.strip()}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return register


def _n(d: Domain) -> int:
    return d.samples.count()


SCORE_SQL = """
, base AS (SELECT score_idx, sum(CASE WHEN ref_effect THEN 2 * weight ELSE 0 END) AS base FROM j GROUP BY score_idx),
upd AS (SELECT j.score_idx, c.sample_idx, sum((CASE WHEN ref_effect THEN -weight ELSE weight END) * coalesce(c.dosage, j.mean)) AS upd
  FROM j JOIN calls c USING (ordinal) GROUP BY ALL),
result AS (SELECT g.score_idx, g.sample_idx, coalesce(base, 0) + coalesce(upd, 0) AS score
  FROM grid g LEFT JOIN base USING (score_idx) LEFT JOIN upd USING (score_idx, sample_idx))
"""
OMIT_SQL = ", j AS (SELECT *, freq AS mean FROM joined WHERE p_size >= 5)" + SCORE_SQL
MEANS_SQL = ", means AS (SELECT ordinal, sum(dosage) / ((SELECT count(*) FROM customer) - count_if(dosage IS NULL)) AS cohort FROM calls GROUP BY ordinal)"
PLAIN = "SELECT score_idx, sample_idx, score FROM result"
#: Sums with cohort means depend on order in the last bits. Dyadic parts end in 00, 25, 50 or 75 at the seventh and eighth
#: digit, so with this offset no sum lies between two numbers of six digits, where those bits would decide.
OFFSET = 1.3e-7
ROUNDED = f"SELECT score_idx, sample_idx, round(score + {OFFSET}, 6) + 0.0 AS score FROM result"


def rounded(scores: DataFrame) -> DataFrame:
    """Six digits, without negative zeros."""
    return scores.withColumn("score", F.round(F.col("score") + OFFSET, 6) + 0.0)


def omit_edges(d: Domain) -> DataFrame:
    return scoring.with_means(d.edges, d.frequencies, None, "omit")


def flagship(d: Domain) -> DataFrame:
    return scoring.evaluate(omit_edges(d), d.calls, d.samples, d.scores, parts=d.parts)


@query(OMIT_SQL + PLAIN)
def score_fixed_freq_omit(d: Domain) -> DataFrame:
    return flagship(d)


@query(MEANS_SQL + ", j AS (SELECT joined.*, cohort AS mean FROM joined LEFT JOIN means USING (ordinal))" + SCORE_SQL + ROUNDED)
def score_cohort_mean(d: Domain) -> DataFrame:
    means = scoring.cohort_means(d.calls, _n(d))
    out = scoring.evaluate(scoring.with_means(d.edges, None, means), d.calls, d.samples, d.scores, parts=d.parts)
    return rounded(out)


@query(MEANS_SQL + ", j AS (SELECT joined.*, CASE WHEN p_size >= 5 THEN freq ELSE cohort END AS mean FROM joined LEFT JOIN means USING (ordinal))" + SCORE_SQL + ROUNDED)
def score_freq_fallback_cohort(d: Domain) -> DataFrame:
    means = scoring.cohort_means(d.calls, _n(d))
    out = scoring.evaluate(scoring.with_means(d.edges, d.frequencies, means, "cohort"), d.calls, d.samples, d.scores, parts=d.parts)
    return rounded(out)


@query(MEANS_SQL + " SELECT 'v' || ordinal AS id, round(cohort, 6) AS cohort_mean FROM means")
def cohort_mean(d: Domain) -> DataFrame:
    return scoring.cohort_means(d.calls, _n(d)).select("id", F.round("cohort_mean", 6).alias("cohort_mean"))


@query(OMIT_SQL + "SELECT c_custkey AS sample_idx, CAST(c_nationkey AS VARCHAR) AS fid, CAST(c_custkey AS VARCHAR) AS iid, " + ", ".join(f"max(CASE WHEN score_idx = {k} THEN score END) AS score{k}" for k in range(N_SCORES)) + " FROM customer JOIN result ON c_custkey = sample_idx GROUP BY ALL")
def score_wide_pivot(d: Domain) -> DataFrame:
    return scoring.wide(flagship(d), [(k, f"score{k}") for k in range(N_SCORES)], d.samples)


@query(OMIT_SQL + "SELECT CAST(output_idx AS BIGINT) AS output_idx, column_name, sample_idx, score FROM result JOIN (VALUES (0, 3, 'third'), (1, 1, 'first')) s(output_idx, score_idx, column_name) USING (score_idx)")
def score_schema_subset_reorder(d: Domain) -> DataFrame:
    """Two of the scores, in another order and under other names, selected before anything is joined."""
    schema = d.spark.createDataFrame([(0, 3, "third"), (1, 1, "first")], "output_idx long, score_idx long, column_name string")
    edges = omit_edges(d).join(F.broadcast(schema), "score_idx").select(F.col("output_idx").alias("score_idx"), "id", "beta", "intercept", "mean")
    out = scoring.evaluate(edges, d.calls, d.samples, schema.select(F.col("output_idx").alias("score_idx")), parts=d.parts)
    return out.withColumnRenamed("score_idx", "output_idx").join(F.broadcast(schema.select("output_idx", "column_name")), "output_idx").select("output_idx", "column_name", "sample_idx", "score")


def ordinal_edges(d: Domain) -> DataFrame:
    rows, _ = d.fragment()
    means = d.variant_list.where("p_size >= 5").select("ordinal", (F.col("p_size") / 32.0).alias("alt_dosage_mean"))
    return scoring.with_means(fragments.edges_of(rows), means, None, "omit", "ordinal")


@query(OMIT_SQL + PLAIN)
def score_fragments(d: Domain) -> DataFrame:
    """Index, support, compile and score by ordinal; equals the direct form."""
    return scoring.evaluate(ordinal_edges(d), d.calls_by("ordinal"), d.samples, d.scores, key="ordinal", parts=d.parts)


@query(OMIT_SQL + PLAIN)
def score_tiled(d: Domain) -> DataFrame:
    """The blocked product: tiles of variants by blocks of samples and scores."""
    return blocked.evaluate_blocked(ordinal_edges(d), d.calls, d.samples, d.scores, tile_of(F.col("ordinal"), BLOCK))


COMMON_SQL = """
, j AS (SELECT *, freq AS mean, CASE WHEN ordinal % 3 = 0 THEN 2 ELSE 0 END AS common FROM joined WHERE p_size >= 5),
base AS (SELECT score_idx, sum(CASE WHEN ref_effect THEN 2 * weight - weight * common ELSE weight * common END) AS base FROM j GROUP BY score_idx),
upd AS (SELECT j.score_idx, c.sample_idx, sum((CASE WHEN ref_effect THEN -weight ELSE weight END) * (coalesce(c.dosage, j.mean) - common)) AS upd
  FROM j JOIN calls c USING (ordinal) GROUP BY ALL)
SELECT g.score_idx, g.sample_idx, coalesce(base, 0) + coalesce(upd, 0) AS score FROM grid g LEFT JOIN base USING (score_idx) LEFT JOIN upd USING (score_idx, sample_idx)
"""


@query(COMMON_SQL)
def score_common_dosage(d: Domain) -> DataFrame:
    """Explicit common dosages: samples that a variant does not list have dosage 2 at every third variant."""
    common = d.variant_list.where("ordinal % 3 = 0").select(F.col("target_id").alias("id"), F.lit(2.0).alias("common"))
    return scoring.evaluate(omit_edges(d), d.calls, d.samples, d.scores, common, parts=d.parts)


#: Nations as samples: each has lines of most parts, so calls are dense. Null where a line is without discount.
NATION_SQL = """
, nd AS (SELECT l_partkey AS ordinal, c_nationkey AS sample_idx, CASE WHEN min(l_discount) > 0 THEN CAST(max(l_linenumber) >= 6 AS INTEGER) + CAST(max(l_linenumber) >= 4 AS INTEGER) END AS dosage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
full_ AS (SELECT v.ordinal, n_nationkey AS sample_idx, CASE WHEN nd.ordinal IS NULL THEN 0 ELSE dosage END AS dosage FROM (SELECT DISTINCT ordinal FROM nd) v, nation LEFT JOIN nd ON nd.ordinal = v.ordinal AND nd.sample_idx = n_nationkey)
"""


def nation_calls(d: Domain) -> DataFrame:
    lines = d.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount").join(d.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    by = lines.join(d.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("l_partkey", "c_nationkey").agg(F.max("l_linenumber").alias("n"), F.min("l_discount").alias("m"))
    dosage = (F.col("n") >= 6).cast("int") + (F.col("n") >= 4).cast("int")
    return by.select(F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_partkey").alias("ordinal"), F.col("c_nationkey").cast("long").alias("sample_idx"), F.when(F.col("m") > 0, dosage).alias("dosage"))


def nations(d: Domain) -> DataFrame:
    return d.table("nation").select(F.col("n_nationkey").cast("long").alias("sample_idx"))


@query(NATION_SQL + """
, c AS (SELECT ordinal, dosage, count(*) AS n FROM full_ GROUP BY ALL), t AS (SELECT count(*) AS samples FROM nation),
m AS (SELECT ordinal, arg_max(coalesce(dosage, 9), (n, -coalesce(dosage, 9))) AS best, max(n) AS most FROM c GROUP BY ALL)
SELECT ordinal, CASE WHEN dense THEN 0.0 WHEN best < 9 THEN CAST(best AS DOUBLE) END AS common, NOT dense AND best = 9 AS missing, exceptions, dense
FROM (SELECT *, samples - most AS exceptions, samples = 1 OR samples - most > least(samples - 1, greatest(1, 3 * (samples // 8))) AS dense FROM m, t)
""")
def common_dosages(d: Domain) -> DataFrame:
    """The most frequent dosage of each variant, found in dense calls, and whether its sparse form is worth it."""
    return dense.common_dosages(nation_calls(d), nations(d).count(), "ordinal").select("ordinal", "common", "missing", F.col("exceptions").cast("long").alias("exceptions"), "dense")


@query(NATION_SQL + """
, j AS (SELECT *, freq AS mean FROM joined WHERE p_size >= 5 AND ordinal IN (SELECT ordinal FROM nd)),
s AS (SELECT j.score_idx, f.sample_idx, sum(CASE WHEN ref_effect THEN weight * (2 - coalesce(f.dosage, j.mean)) ELSE weight * coalesce(f.dosage, j.mean) END) AS score FROM j JOIN full_ f USING (ordinal) GROUP BY ALL)
SELECT g.score_idx, CAST(n_nationkey AS BIGINT) AS sample_idx, coalesce(score, 0.0) AS score FROM (SELECT * FROM scores, nation) g LEFT JOIN s ON s.score_idx = g.score_idx AND s.sample_idx = n_nationkey
""")
def score_sparse_from_dense(d: Domain) -> DataFrame:
    """Dense calls in sparse form, with each variant's own common dosage; equals the dense sum."""
    calls = stored(nation_calls(d).select("id", "sample_idx", "dosage"))
    sparse, common = dense.sparse_form(calls, nations(d))
    edges = omit_edges(d).join(calls.select("id").distinct(), "id", "left_semi")
    return scoring.evaluate(edges, sparse, nations(d), d.scores, common)


@query(OMIT_SQL + PLAIN)
def score_sharded_union(d: Domain) -> DataFrame:
    """Two shards of variants, scored apart and added: scores are additive over variants."""
    parts = [scoring.evaluate(omit_edges(d).where(f"pmod(xxhash64(id), 2) = {k}"), d.calls, d.samples, d.scores, parts=d.parts) for k in range(2)]
    return parts[0].unionByName(parts[1]).groupBy("score_idx", "sample_idx").agg(F.sum("score").alias("score"))


@query(OMIT_SQL + PLAIN)
def score_streamed_shards(d: Domain) -> DataFrame:
    """Shards as a file stream: each micro-batch adds its updates to the sums of (score, sample)."""
    return score_stream_to_table(d.spark, omit_edges(d), d.calls, d.samples, d.scores, parts=d.parts)


@query(OMIT_SQL + "SELECT j.score_idx, c.sample_idx, sum((CASE WHEN ref_effect THEN -weight ELSE weight END) * coalesce(c.dosage, j.mean)) AS score FROM j JOIN calls c USING (ordinal) GROUP BY ALL")
def score_strict_order(d: Domain) -> DataFrame:
    """Updates summed in stored order, for bit-identical repeats."""
    means = d.frequencies.select("id", F.col("alt_dosage_mean").alias("mean"))
    rows = d.bound.where("status = 'matched'").select("score_idx", "id", "row_seq", "beta").join(means, "id")
    return scoring.ordered_updates(rows, d.calls, "ordinal", "row_seq", parts=d.parts).withColumnRenamed("upd", "score")


QC_SQL = """
, w AS (SELECT w.*, v.p_size FROM weights w LEFT JOIN variants v USING (ordinal)),
qc AS (SELECT score_idx, count(*) AS input_weights, count_if(weight = 0) AS zero_weights, CAST(0 AS BIGINT) AS excluded_weights,
  count_if(weight <> 0) - count(DISTINCT CASE WHEN weight <> 0 THEN ordinal END) AS duplicate_weights, count_if(weight <> 0) AS catalog_weights,
  count_if(weight <> 0 AND p_size <> 7) AS matched_weights, count_if(weight <> 0 AND p_size = 7) AS missing_variants,
  count_if(weight <> 0 AND p_size <> 7 AND NOT ref_effect) AS alt_effects, count_if(weight <> 0 AND p_size <> 7 AND ref_effect) AS ref_effects,
  CAST(coalesce(sum(CASE WHEN weight <> 0 AND p_size <> 7 AND ref_effect THEN 2 * weight END), 0) AS DOUBLE) AS ref_intercept FROM w GROUP BY score_idx)
"""
QC_INTS = "input_weights zero_weights excluded_weights duplicate_weights catalog_weights matched_weights missing_variants alt_effects ref_effects".split()
QC_COLUMNS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in QC_INTS) + ", ref_intercept"


def qc(d: Domain) -> DataFrame:
    counts = weights.catalog_counts(weights.flag_weights(d.weights))
    return counts.join(weights.bound_counts(d.bound), "score_idx", "left")


@query(QC_SQL + f"SELECT score_idx, {QC_COLUMNS} FROM qc")
def weight_qc(d: Domain) -> DataFrame:
    return qc(d)


@query(QC_SQL + "SELECT score_idx, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in QC_INTS) + ", sum(ref_intercept) AS ref_intercept FROM qc GROUP BY ROLLUP (score_idx)")
def weight_qc_rollup(d: Domain) -> DataFrame:
    return weights.totals(qc(d))


#: A whitelist: the variants that have a frequency.
LISTED_SQL = """
, w AS (SELECT w.*, v.p_size >= 5 AS listed FROM weights w JOIN variants v USING (ordinal)),
k AS (SELECT score_idx, ordinal, count(*) AS n, count_if(weight = 0) AS z, count_if(weight <> 0 AND NOT listed) AS x, count_if(weight <> 0 AND listed) AS k FROM w GROUP BY ALL)
SELECT score_idx, CAST(sum(n) AS BIGINT) AS input_weights, CAST(sum(z) AS BIGINT) AS zero_weights, CAST(sum(x) AS BIGINT) AS excluded_weights, CAST(sum(greatest(k - 1, 0)) AS BIGINT) AS duplicate_weights, CAST(sum(k) AS BIGINT) AS catalog_weights FROM k GROUP BY score_idx
"""


@query(LISTED_SQL)
def weight_qc_whitelist(d: Domain) -> DataFrame:
    """Counts of weights limited to a whitelist: what it lacks is excluded."""
    return weights.compile_catalog(d.weights, d.frequencies)[1]


@query("""
SELECT snp AS source_id, least(ref, alt) AS allele0, greatest(ref, alt) AS allele1, score_idx, row_seq,
  CASE WHEN ref_effect THEN ref ELSE alt END AS effect, CASE WHEN ref_effect THEN alt ELSE ref END AS other, CAST(weight AS DOUBLE) AS weight
FROM weights JOIN variants USING (ordinal) WHERE weight <> 0
""")
def catalog_compile(d: Domain) -> DataFrame:
    return d.catalog


@query("""
SELECT source_id, list_sort(list(CAST(weight AS DOUBLE))) AS weights FROM weights JOIN variants USING (ordinal) WHERE weight <> 0 GROUP BY source_id
""")
def catalog_by_variant(d: Domain) -> DataFrame:
    """Variant-major form: a variant's weights as one sorted list."""
    met = d.catalog.join(d.variant_list.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("s")), "source_id")
    return met.groupBy(F.col("s").alias("source_id")).agg(F.sort_array(F.collect_list("weight")).alias("weights"))


@query("SELECT ordinal, source_id, target_id, ref, alt, ordinal // 1000 AS block, ordinal // 1000 AS tile_idx FROM variants")
def variant_index(d: Domain) -> DataFrame:
    return d.index


@query("SELECT source_id AS alias, ordinal FROM variants UNION SELECT target_id, ordinal FROM variants")
def variant_aliases(d: Domain) -> DataFrame:
    return d.aliases


@query("SELECT score_idx, count(*) AS n_rows, count(DISTINCT ordinal) AS n_variants, CAST(count_if(v.ordinal IS NULL) AS BIGINT) AS n_unknown FROM weights w LEFT JOIN variants v USING (ordinal) GROUP BY score_idx")
def variant_alias_lookup(d: Domain) -> DataFrame:
    met = d.weights.join(d.aliases, F.col("snp") == F.col("alias"), "left")
    return met.groupBy("score_idx").agg(F.count("*").alias("n_rows"), F.count_distinct("ordinal").alias("n_variants"), F.count_if(F.col("ordinal").isNull()).alias("n_unknown"))


@query("SELECT ordinal, 0 AS input_idx, ordinal AS pgen_variant_idx FROM variants WHERE p_size <> 7")
def variant_locations(d: Domain) -> DataFrame:
    return variants.locate(d.pvar, d.aliases, d.index)


@query("""
, r AS (SELECT ordinal AS k, CAST(1 AS BIGINT) AS n, sha256(concat(strlen(source_id), ':', source_id, strlen(target_id), ':', target_id, strlen(ref), ':', ref, strlen(alt), ':', alt)) AS h FROM variants),
a AS (SELECT k >> 8 AS k, sum(n) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM r GROUP BY k >> 8),
b AS (SELECT k >> 8 AS k, sum(n) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a GROUP BY k >> 8),
c AS (SELECT k >> 8 AS k, sum(n) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM b GROUP BY k >> 8),
e AS (SELECT k >> 8 AS k, sum(n) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM c GROUP BY k >> 8)
SELECT sha256(n || ':' || h) AS signature FROM e
""")
def lineage_signature(d: Domain) -> DataFrame:
    return variants.lineage(d.index)


STATE_SQL = "CASE WHEN p_size = 7 THEN 0 WHEN p_size < 5 THEN 1 ELSE 2 END"


@query(f"SELECT ordinal, CAST({STATE_SQL} AS INTEGER) AS state FROM variants")
def support_states(d: Domain) -> DataFrame:
    return d.support


@query(f"SELECT CAST({STATE_SQL} AS INTEGER) AS state, count(*) AS n_variants FROM variants GROUP BY ALL")
def support_summary(d: Domain) -> DataFrame:
    return support.summary(d.support)


FRAG_SQL = f"""
, w AS (SELECT w.score_idx, w.row_seq, w.ordinal, CAST(w.weight AS DOUBLE) AS weight, w.ref_effect, {STATE_SQL} AS state FROM weights w JOIN variants v USING (ordinal)),
qc AS (SELECT score_idx, CAST(count(*) AS BIGINT) AS input_weights, count_if(weight = 0) AS zero_weights, CAST(0 AS BIGINT) AS excluded_weights,
  count_if(weight <> 0) - count(DISTINCT CASE WHEN weight <> 0 THEN ordinal END) AS duplicate_weights, count_if(weight <> 0) AS catalog_weights,
  count_if(weight <> 0 AND state = 2) AS reference_supported_weights, count_if(weight <> 0 AND state = 0) AS reference_missing_variant_weights,
  count_if(weight <> 0 AND state = 1) AS reference_missing_frequency_weights, sum(abs(weight)) AS nonzero_weight_l1, sum(weight * weight) AS nonzero_weight_l2_squared,
  sum(abs(weight)) AS catalog_weight_l1, sum(weight * weight) AS catalog_weight_l2_squared,
  sum(CASE WHEN state = 2 THEN abs(weight) ELSE 0 END) AS reference_supported_weight_l1, sum(CASE WHEN state = 2 THEN weight * weight ELSE 0 END) AS reference_supported_weight_l2_squared
  FROM w GROUP BY score_idx)
"""
FRAG_INTS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in fragments.COUNTS)
SCREEN = 0.895


@query(FRAG_SQL + "SELECT score_idx, ordinal, ordinal // 1000 AS tile_idx, row_seq, weight, ref_effect FROM w WHERE weight <> 0 AND state = 2")
def fragment_compile(d: Domain) -> DataFrame:
    return d.fragment()[0]


@query(FRAG_SQL + f"SELECT score_idx, ordinal, ordinal // 1000 AS tile_idx, row_seq, weight, ref_effect FROM w JOIN qc USING (score_idx) WHERE weight <> 0 AND state = 2 AND reference_supported_weights / catalog_weights >= {SCREEN}")
def fragment_screened(d: Domain) -> DataFrame:
    return d.fragment(SCREEN)[0]


@query(FRAG_SQL + f"""
SELECT score_idx, {FRAG_INTS}, {', '.join(fragments.MASSES)}, reference_supported_weights / catalog_weights AS reference_supported_fraction,
  reference_supported_weight_l1 / catalog_weight_l1 AS reference_supported_l1_fraction, reference_supported_weight_l2_squared / catalog_weight_l2_squared AS reference_supported_l2_squared_fraction,
  CASE WHEN reference_supported_weights / catalog_weights >= {SCREEN} THEN 'eligible' ELSE 'excluded_low_reference_coverage' END AS status FROM qc
""")
def fragment_qc_status(d: Domain) -> DataFrame:
    return d.fragment(SCREEN)[1]


@query(FRAG_SQL.replace("FROM weights w JOIN variants v USING (ordinal))", "FROM weights w LEFT JOIN (SELECT * FROM variants WHERE p_size >= 5) v USING (ordinal))").replace(", w.ordinal,", ", CASE WHEN v.p_size IS NOT NULL THEN w.ordinal END AS ordinal,")
  .replace("CAST(0 AS BIGINT) AS excluded_weights", "count_if(weight <> 0 AND ordinal IS NULL) AS excluded_weights").replace("count_if(weight <> 0) - count", "count_if(weight <> 0 AND ordinal IS NOT NULL) - count").replace("count_if(weight <> 0) AS catalog", "count_if(weight <> 0 AND ordinal IS NOT NULL) AS catalog")
  .replace("state = ", "ordinal IS NOT NULL AND state = ").replace("sum(abs(weight)) AS catalog", "sum(CASE WHEN ordinal IS NOT NULL THEN abs(weight) ELSE 0 END) AS catalog").replace("sum(weight * weight) AS catalog", "sum(CASE WHEN ordinal IS NOT NULL THEN weight * weight ELSE 0 END) AS catalog")
  + f"SELECT score_idx, {FRAG_INTS}, {', '.join(fragments.MASSES)} FROM qc")
def fragment_qc_excluded(d: Domain) -> DataFrame:
    """Weights compiled against an index that lacks the variants without a frequency: those are excluded."""
    known = d.variant_list.where("p_size >= 5").drop("p_size")
    index = variants.build_index(known, block=BLOCK)
    _, counts = fragments.compile_fragment(d.weights, variants.aliases_of(index, check=False), index, d.support, block=BLOCK, validate=False)
    return counts.select("score_idx", *fragments.COUNTS, *fragments.MASSES)


@query(FRAG_SQL + """
, f AS (SELECT *, ordinal % 3 <> 0 AS ok FROM w WHERE weight <> 0 AND state = 2),
s AS (SELECT score_idx, count(*) AS n, count_if(ok) AS m, sum(abs(weight)) AS a, sum(CASE WHEN ok THEN abs(weight) ELSE 0 END) AS b, sum(weight * weight) AS c, sum(CASE WHEN ok THEN weight * weight ELSE 0 END) AS e FROM f GROUP BY score_idx)
SELECT score_idx, n AS reference_weight_count, CAST(m AS BIGINT) AS target_available_weight_count, m / n AS target_available_fraction, a AS reference_abs_weight, b AS target_available_abs_weight,
  b / a AS target_available_abs_weight_fraction, c AS reference_squared_weight, e AS target_available_squared_weight, e / c AS target_available_squared_weight_fraction FROM s
""")
def fragment_availability(d: Domain) -> DataFrame:
    target = d.index.select("ordinal", F.when(F.col("ordinal") % 3 != 0, support.USABLE).otherwise(support.MISSING_VARIANT).alias("state"))
    return fragments.availability(d.fragment()[0], target)


def halves(d: Domain) -> list[DataFrame]:
    rows = d.fragment()[0]
    return [fragments.variant_bits(rows.where(f"score_idx % 2 = {k}")) for k in range(2)]


@query(FRAG_SQL + "SELECT DISTINCT ordinal FROM w WHERE weight <> 0 AND state = 2")
def variant_bits_union(d: Domain) -> DataFrame:
    return fragments.merge_bits(halves(d))


@query(FRAG_SQL + "SELECT count(DISTINCT ordinal) AS n_variants FROM w WHERE weight <> 0 AND state = 2")
def variant_bitmap_union_count(d: Domain) -> DataFrame:
    """The same union as bitmaps: buckets are merged by OR and counted by bits."""
    both = fragments.bit_buckets(halves(d)[0]).unionByName(fragments.bit_buckets(halves(d)[1]))
    merged = both.groupBy("bucket").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("n"))
    return merged.agg(F.sum("n").alias("n_variants"))


@query(FRAG_SQL + "SELECT ordinal // 1000 AS tile_idx, count(DISTINCT score_idx) AS n_scores, count(DISTINCT ordinal) AS n_variants, count(*) AS n_edges FROM w WHERE weight <> 0 AND state = 2 GROUP BY ALL")
def tile_statistics(d: Domain) -> DataFrame:
    return fragments.tile_statistics(d.fragment()[0])


def _frequency_rows(d: Domain, columns: dict) -> DataFrame:
    rows = d.variant_list.select(F.col("target_id").alias("ID"), F.col("ref").alias("REF"), F.lower("alt").alias("ALT"), "p_size")
    return rows.select("ID", "REF", "ALT", *(e.alias(c) for c, e in columns.items()))


def _size() -> Column:
    return F.col("p_size")


def _frequency_sql(mean: str, where: str = "true") -> str:
    return f"SELECT target_id AS id, ref, alt, CAST({mean} AS DOUBLE) AS alt_dosage_mean FROM variants WHERE {where}"


@query(_frequency_sql("p_size / 32.0", "p_size % 10 <> 3"))
def frequency_normalise_mean(d: Domain) -> DataFrame:
    return frequency.normalise(_frequency_rows(d, {"ALT_DOSAGE_MEAN": F.when(_size() % 10 == 3, F.lit("NaN")).otherwise((_size() / 32.0).cast("string"))}))


@query(_frequency_sql("p_size / 32.0", "p_size % 10 <> 3"))
def frequency_normalise_freq(d: Domain) -> DataFrame:
    value = (_size() / 64.0).cast("string")
    named = F.when(_size() % 2 == 0, F.concat(F.col("ALT"), F.lit("="), value)).otherwise(value)
    rows = _frequency_rows(d, {"p_size": _size()})
    return frequency.normalise(rows.withColumn("ALT_FREQS", F.when(_size() % 10 == 3, F.lit(".")).otherwise(named)).drop("p_size"))


@query(_frequency_sql("2 * p_size / 64.0", "p_size % 10 <> 3"))
def frequency_normalise_alt_ct(d: Domain) -> DataFrame:
    return frequency.normalise(_frequency_rows(d, {"ALT_CTS": _size().cast("string"), "OBS_CT": F.when(_size() % 10 == 3, F.lit("0")).otherwise(F.lit("64"))}))


@query(_frequency_sql("2 * (64 - p_size) / 64.0", "p_size % 10 <> 3"))
def frequency_normalise_ref_ct(d: Domain) -> DataFrame:
    return frequency.normalise(_frequency_rows(d, {"REF_CT": _size().cast("string"), "OBS_CT": F.when(_size() % 10 == 3, F.lit("na")).otherwise(F.lit("64"))}))


@query("SELECT ordinal AS pgen_variant_idx, '1' AS chrom, target_id AS id, ref, alt FROM variants WHERE p_size <> 7 AND ordinal IN (SELECT ordinal FROM weights WHERE weight <> 0)")
def pvar_semi_filter(d: Domain) -> DataFrame:
    return d.pvar.join(d.catalog.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").select("pgen_variant_idx", "chrom", "id", "ref", "alt")


@query("SELECT score_idx, row_seq, snp FROM weights JOIN variants USING (ordinal) WHERE weight <> 0 AND p_size = 7")
def unmatched_weights(d: Domain) -> DataFrame:
    return d.catalog.join(d.pvar, F.col("source_id") == F.col("id"), "left_anti").select("score_idx", "row_seq", F.col("source_id").alias("snp"))


@query("""
SELECT CAST(count(DISTINCT ordinal) AS BIGINT) AS variant_ct, CAST(count(*) AS BIGINT) AS edge_ct, CAST(count(DISTINCT CASE WHEN p_size >= 5 THEN ordinal END) AS BIGINT) AS external_frequency_variant_ct,
  CAST(count(DISTINCT CASE WHEN p_size < 5 THEN ordinal END) AS BIGINT) AS missing_frequency_variant_ct, CAST(count_if(p_size < 5) AS BIGINT) AS omitted_edge_ct,
  CAST((SELECT count(*) FROM calls WHERE dosage IS NULL AND ordinal IN (SELECT ordinal FROM joined WHERE p_size >= 5)) AS BIGINT) AS imputed_value_ct
FROM joined
""")
def run_statistics(d: Domain) -> DataFrame:
    """Logical counters of a run under the policy ``omit``."""
    e = d.edges.join(d.frequencies.select("id", F.lit(True).alias("known")), "id", "left")
    known = F.col("known").isNotNull()
    some = lambda rule: F.count_distinct(F.when(rule, F.col("id")))
    edges = e.agg(F.count_distinct("id").alias("variant_ct"), F.count("*").alias("edge_ct"), some(known).alias("external_frequency_variant_ct"), some(~known).alias("missing_frequency_variant_ct"), F.count_if(~known).alias("omitted_edge_ct"))
    imputed = d.calls.where("dosage IS NULL").join(e.where(known).select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("imputed_value_ct"))
    return edges.crossJoin(imputed)


@query("SELECT score_idx, sum(CASE WHEN ref_effect THEN 2 * weight ELSE 0 END) AS base, count(DISTINCT ordinal) / (SELECT count(*) FROM variants) AS density FROM joined GROUP BY score_idx")
def score_baselines(d: Domain) -> DataFrame:
    e = scoring.combined(d.edges)
    total = d.index.agg(F.count("*").alias("total"))  # one row
    sums = e.groupBy("score_idx").agg(F.sum("intercept").alias("base"), F.count("*").alias("n"))
    return sums.crossJoin(total).select("score_idx", "base", fraction(F.col("n"), F.col("total")).alias("density"))


