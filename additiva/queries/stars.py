"""The domain's tables, derived from the star-schema tables of the driver.

Weights, means and dosages are dyadic rationals, so sums are exact and independent of order. This adapter belongs to
the registered queries; the operators do not know it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.operators.checks import BROADCAST_ROWS
from additiva.operators.fragments import compile_fragment
from additiva.operators.scoring import dealt, parts_of
from additiva.operators.support import build_support
from additiva.operators.variants import aliases_of, build_index
from additiva.operators.weights import bind, compile_catalog

N_SCORES, BLOCK = 16, 1000


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_nationkey").cast("string").alias("fid"), F.col("c_custkey").cast("string").alias("iid"))

    @cached_property
    def scores(self) -> DataFrame:
        return self.spark.range(N_SCORES).select(F.col("id").alias("score_idx"))

    @cached_property
    def variant_list(self) -> DataFrame:
        k = F.col("p_partkey") % 4
        pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
        key = F.col("p_partkey").cast("string")
        rows = self.table("part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("s"), key).alias("source_id"), F.concat(F.lit("v"), key).alias("target_id"), pick("A", "C", "G", "T").alias("ref"), pick("G", "T", "A", "C").alias("alt"), "p_size")
        # By the size of its compressed file Spark would send millions of variants through the driver, once for each table made from them.
        return rows.hint("merge") if rows.count() > BROADCAST_ROWS else rows

    @cached_property
    def index(self) -> DataFrame:
        return build_index(self.variant_list.drop("p_size"), block=BLOCK)

    @cached_property
    def aliases(self) -> DataFrame:
        return aliases_of(self.index, check=False)

    @cached_property
    def pvar(self) -> DataFrame:
        return self.variant_list.where("p_size <> 7").select(F.col("ordinal").alias("pgen_variant_idx"), F.lit("1").alias("chrom"), F.col("target_id").alias("id"), "ref", "alt")

    @cached_property
    def frequencies(self) -> DataFrame:
        return self.variant_list.where("p_size >= 5").select(F.col("target_id").alias("id"), "ref", "alt", (F.col("p_size") / 32.0).alias("alt_dosage_mean"))

    @cached_property
    def weights(self) -> DataFrame:
        rows = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
        k, is_ref = F.col("l_partkey") % 4, F.col("l_linestatus") == "O"
        pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
        ref, alt = pick("A", "C", "G", "T"), pick("G", "T", "A", "C")
        return rows.select(
            (F.col("l_suppkey") % N_SCORES).alias("score_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_seq"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("snp"),
            F.when(is_ref, ref).otherwise(alt).alias("effect"), F.when(is_ref, alt).otherwise(ref).alias("other"), ((F.col("l_linenumber") - 4) / 8.0).alias("weight"),
        )

    @cached_property
    def parts(self) -> int:
        """Parts for whatever grows with the lines."""
        return parts_of(self.table("lineitem").count())

    @cached_property
    def calls(self) -> DataFrame:
        return self.calls_by("id")

    def calls_by(self, key: str) -> DataFrame:
        """(id, ordinal, sample_idx, dosage): exceptions from a common dosage of 0; null is missing. Dealt out by ``key``, "id" or "ordinal"."""
        variant = F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("id")
        orders = dealt(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample_idx")), self.parts, "l_orderkey")
        items = dealt(self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("ordinal"), "l_quantity", "l_discount"), self.parts, "l_orderkey").join(orders, "l_orderkey")
        rows = items.select("sample_idx", "ordinal", *([variant] if key == "id" else []), (F.col("l_quantity") % 3).alias("d"), (F.col("l_discount") >= 0.09).alias("m"))
        by = dealt(rows, self.parts, key).groupBy(*dict.fromkeys([key, "ordinal", "sample_idx"])).agg(F.max("d").alias("d"), F.bool_or("m").alias("m"))
        return by.select("id" if key == "id" else variant, "ordinal", "sample_idx", F.when(~F.col("m"), F.col("d")).alias("dosage"))

    @cached_property
    def catalog(self) -> DataFrame:
        return compile_catalog(self.weights, validate=False)[0]

    @cached_property
    def bound(self) -> DataFrame:
        return bind(self.catalog, self.pvar, validate=False)

    @cached_property
    def edges(self) -> DataFrame:
        return self.bound.where("status = 'matched'").select("score_idx", "id", "beta", "intercept")

    @cached_property
    def support(self) -> DataFrame:
        freq = self.variant_list.where("p_size >= 5").select("ordinal", (F.col("p_size") / 32.0).alias("alt_dosage_mean"))
        located = self.variant_list.where("p_size <> 7").select("ordinal")
        return build_support(self.index, located, freq)

    def fragment(self, minimum: float = 0.0) -> tuple[DataFrame, DataFrame]:
        return compile_fragment(self.weights, self.aliases, self.index, self.support, minimum, BLOCK, validate=False)



#: The same tables for the SQL side.
SQL = """
variants AS (SELECT p_partkey AS ordinal, 's' || p_partkey AS source_id, 'v' || p_partkey AS target_id, p_size,
  CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS ref,
  CASE p_partkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'A' ELSE 'C' END AS alt FROM part),
weights AS (SELECT l_suppkey % 16 AS score_idx, l_orderkey * 8 + l_linenumber AS row_seq, l_partkey AS ordinal, 'v' || l_partkey AS snp,
  (l_linenumber - 4) / 8.0 AS weight, l_linestatus = 'O' AS ref_effect FROM lineitem),
calls AS (SELECT l_partkey AS ordinal, o_custkey AS sample_idx, CASE WHEN NOT bool_or(l_discount >= 0.09) THEN max(l_quantity % 3) END AS dosage, true AS listed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
scores AS (SELECT CAST(range AS BIGINT) AS score_idx FROM range(16)),
grid AS (SELECT score_idx, c_custkey AS sample_idx FROM scores, customer),
joined AS (SELECT w.score_idx, w.ordinal, CAST(w.weight AS DOUBLE) AS weight, w.ref_effect, v.p_size, v.p_size / 32.0 AS freq FROM weights w JOIN variants v USING (ordinal) WHERE w.weight <> 0 AND v.p_size <> 7)
"""
