"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from additiva.queries import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(tuple(r[k]) if isinstance(r[k], list) else r[k] for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sql, name):
    found = registry.QUERIES[name](spark, DIR)
    want = sql.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_signature_depends_on_order(spark):
    from pyspark.sql import functions as F

    from additiva.operators.variants import signature
    from additiva.queries.stars import Domain

    index = Domain(spark, DIR).index
    assert signature(index) == signature(index.repartition(3)) != signature(index.withColumn("ordinal", F.lit(199) - F.col("ordinal")))


def test_weight_files_are_one_job(spark, tmp_path):
    """All scores' files come from one write; each part begins with the header, rows keep their order."""
    from additiva.queries import files
    from additiva.queries.stars import Domain
    from additiva.sources import inputs

    d = Domain(spark, DIR)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    manifest = files.weight_files(d, f"{tmp_path}/w")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(jobs) < 30
    parts = sorted((tmp_path / "w" / "files" / "score=3").glob("part-*"))
    assert parts and all(p.read_text().startswith("EFFECT_ALLELE_WEIGHT\t") for p in parts)
    found = inputs.read_weights(spark, inputs.read_manifest(spark, manifest)).where("score_idx = 3").orderBy("row_seq").collect()
    want = d.weights.where("score_idx = 3").orderBy("row_seq").collect()
    assert [(r["snp"], r["effect"], r["weight"]) for r in found] == [(r["snp"], r["effect"], r["weight"]) for r in want]


def test_calls_meet_weights_as_one_row(spark):
    """The join of calls has a row a call, and after it one shuffle, by sample; the grid is no join."""
    from pyspark.sql import functions as F

    from additiva.operators import scoring

    edges = spark.range(90).select((F.col("id") % 9).alias("score_idx"), F.floor(F.col("id") / 9).alias("id"), F.lit(1.0).alias("beta"), F.lit(0.0).alias("intercept"), F.lit(0.5).alias("mean"))
    calls = spark.createDataFrame([(1, 0, 2.0), (2, 0, None), (3, 7, 1.0)], "id long, sample_idx long, dosage double")
    assert scoring._packed(edges, calls, "id", None).count() == 3
    samples, scores = spark.range(3).toDF("sample_idx"), spark.range(11).toDF("score_idx")
    out = scoring.evaluate(edges, calls, samples, scores)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" not in plan.split("RepartitionByExpression")[0]
    # Sample 7 is not of the cohort; scores without weights have 0.
    assert {tuple(r) for r in out.collect()} == {(k, s, 2.5 if s == 0 and k < 9 else 0.0) for k in range(11) for s in range(3)}
