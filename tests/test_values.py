import random

from pyspark.sql import functions as F
import pytest

from additiva.functions import values as v
from additiva.operators import blocked, dense, fragments, scoring
from additiva.operators.variants import aliases_of, build_index


def test_number(spark):
    cases = {"1": 1.0, "-2.5e3": -2500.0, ".5": 0.5, "1d": None, "1e400": None, "1e-400": None, "0e-400": 0.0, "0x10": None, "": None, "NaN": None, "inf": None, "1 2": None, "5.": 5.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", v.number(F.col("t")).alias("n")).collect()} == cases


def test_small_rules(spark):
    row = spark.range(1).select(
        v.is_missing(F.lit("nAn")).alias("a"), v.allele_value(F.lit("T=8"), F.lit("T")).alias("b"), v.allele_value(F.lit("G=8"), F.lit("T")).alias("c"), v.allele_value(F.lit("T=8,G=1"), F.lit("T")).alias("d"),
        v.ascii_upper(F.lit("aé")).alias("e"), v.stripped(F.lit("p:x"), "p:").alias("f"), v.stripped(F.lit("p:"), "p:").alias("g"), v.fraction(F.lit(1), F.lit(0)).alias("h"),
    ).first()
    assert tuple(row) == (True, "8", None, None, "Aé", "x", None, 0.0)
    assert v.general17(1 / 3) == "0.33333333333333331" and v.general17(2.0) == "2"
    assert v.tile_size(100_000) == 2000 and v.tile_size(2) == 2
    with pytest.raises(ValueError):
        v.tile_size(3001)


def test_fragment_quality(spark):
    """The rows and totals of case G14 in FIXTURES.md."""
    index = build_index(spark.createDataFrame([(0, "s1", "v1", "A", "G"), (1, "s2", "v2", "C", "T"), (2, "s3", "v3", "G", "A")], "ordinal long, source_id string, target_id string, ref string, alt string"), block=2)
    support = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "ordinal long, state int")
    w = [(0, 0, "v1", "G", "A", 2.0), (0, 1, "v2", "C", "T", 3.0), (0, 2, "outside", "C", "T", 5.0), (0, 3, "s1", "G", "A", 4.0), (1, 0, "v3", "G", "A", -1.0), (1, 1, "v2", "C", "T", 0.0)]
    weights = spark.createDataFrame(w, "score_idx int, row_seq long, snp string, effect string, other string, weight double")
    rows, qc = fragments.compile_fragment(weights, aliases_of(index), index, support, 0.5, 2)
    q = {r["score_idx"]: r for r in qc.collect()}
    total = lambda c: sum(r[c] for r in q.values())
    assert [total(c) for c in fragments.COUNTS] == [6, 1, 1, 1, 4, 2, 1, 1]
    assert [q[0][c] for c in fragments.MASSES] == [14, 54, 9, 29, 6, 20]
    assert q[0]["status"] == "eligible" and q[1]["status"] == "excluded_low_reference_coverage"
    assert rows.count() == 2 and fragments.variant_bits(rows).count() == 1
    a = fragments.availability(rows, support).first()
    assert (a["target_available_weight_count"], a["reference_abs_weight"], a["reference_squared_weight"]) == (2, 6, 20)


def test_sparse_form_equals_the_dense_sum(spark):
    """Random dyadic cohorts: common dosages, missing calls, both orientations, tiles and splits give the plain sum exactly."""
    rng = random.Random(11)
    n_samples, n_variants, n_scores = 60, 14, 3
    common = {v: float(rng.choice([0, 0, 1, 2])) for v in range(n_variants)}
    mean = {v: rng.randrange(33) / 16 for v in range(n_variants)}
    dosage = {(v, s): rng.choice([None, 0.0, 1.0, 2.0, 0.5]) if rng.random() < 0.2 else common[v] for v in range(n_variants) for s in range(n_samples)}
    weights = [(k, v, rng.randrange(-16, 17) / 8, rng.random() < 0.5) for k in range(n_scores) for v in range(n_variants) if rng.random() < 0.7]
    want = {(k, s): 0.0 for k in range(n_scores) for s in range(n_samples)}
    for k, v, w, ref in weights:
        for s in range(n_samples):
            x = mean[v] if dosage[v, s] is None else dosage[v, s]
            want[k, s] += w * (2 - x) if ref else w * x
    calls = spark.createDataFrame([(v, s, x) for (v, s), x in dosage.items() if x != common[v]], "ordinal long, sample_idx long, dosage double")
    edges = spark.createDataFrame([(k, v, -w if ref else w, 2 * w if ref else 0.0, mean[v]) for k, v, w, ref in weights], "score_idx long, ordinal long, beta double, intercept double, mean double")
    usual = spark.createDataFrame(list(common.items()), "ordinal long, common double")
    samples, scores = spark.range(n_samples).toDF("sample_idx"), spark.range(n_scores).toDF("score_idx")
    plain = lambda df: {(r[0], r[1]): r[2] for r in df.select("score_idx", "sample_idx", "score").collect()}
    assert plain(scoring.evaluate(edges, calls, samples, scores, usual, "ordinal")) == want
    assert plain(blocked.evaluate_blocked(edges, calls, samples, scores, F.floor(F.col("ordinal") / 4), usual)) == want
    parts = [scoring.evaluate(edges.where(f"ordinal % 3 = {k}"), calls, samples, scores, usual, "ordinal") for k in range(3)]
    both = parts[0].union(parts[1]).union(parts[2]).groupBy("score_idx", "sample_idx").agg(F.sum("score").alias("score"))
    assert plain(both) == want


def test_blocks_split_variants_and_scores(spark):
    """Samples and scores beyond one block, a variant called in every sample, one in every score."""
    rng = random.Random(4)
    n_samples, n_scores = 2 * blocked.SAMPLES + 3, blocked.SCORES + 2
    calls = [(0, s, rng.choice([None, 1.0, 2.0])) for s in range(n_samples)] + [(1, s, 1.0) for s in range(0, n_samples, 999)]
    weights = [(k, 1, 0.5 * (k % 5) - 1) for k in range(n_scores)] + [(k, 0, 0.25) for k in (0, n_scores - 1)]
    c = spark.createDataFrame(calls, "ordinal long, sample_idx long, dosage double")
    edges = spark.createDataFrame([(k, v, w, 0.0, 0.5) for k, v, w in weights], "score_idx long, ordinal long, beta double, intercept double, mean double")
    updates = blocked.products(edges.withColumn("common", F.lit(0.0)), c, n_scores, n_samples - 1, F.lit(0).cast("long"))
    found = {(r[0], r[1]): r[2] for r in updates.collect()}
    want = {}
    for k, v, w in weights:
        for u, s, x in calls:
            if u == v:
                want[k, s] = want.get((k, s), 0.0) + w * (0.5 if x is None else x)
    assert found == want


def test_sparse_form_of_dense_calls(spark):
    """Common dosages of any kind, missing ones too, from dense and from part-dense calls; scores equal the plain sums."""
    rng = random.Random(8)
    n, variants = 24, 40
    kinds = [0.0, 1.0, 2.0, None, 0.5]
    plain = {}
    for v in range(variants):
        usual, noise = rng.choice(kinds), rng.choice([0.02, 0.2, 0.6])
        for s in range(n):
            plain[v, s] = rng.choice(kinds) if rng.random() < noise else usual
    samples, scores = spark.range(n).toDF("sample_idx"), spark.range(2).toDF("score_idx")
    edges = spark.createDataFrame([(k, v, (v % 7 - 3) / 4, 0.5, 0.75) for k in range(2) for v in range(variants)], "score_idx long, id long, beta double, intercept double, mean double")
    want = {(k, s): sum((v % 7 - 3) / 4 * (0.75 if plain[v, s] is None else plain[v, s]) + 0.5 for v in range(variants)) for k in range(2) for s in range(n)}
    for listed in (plain, {k: x for k, x in plain.items() if x != 0}):
        calls = spark.createDataFrame([(v, s, x) for (v, s), x in listed.items()], "id long, sample_idx long, dosage double")
        sparse, common = dense.sparse_form(calls, samples)
        found = {(r[0], r[1]): r[2] for r in scoring.evaluate(edges, sparse, samples, scores, common).collect()}
        assert found == want
        rows = {r["id"]: r for r in dense.common_dosages(calls, n).collect()}
        left = {r["id"]: r["count"] for r in sparse.groupBy("id").count().collect()}
        for v, r in rows.items():
            column = [plain[v, s] for s in range(n)]
            most = max(map(column.count, kinds))
            assert r["dense"] == (n - most > dense.most_exceptions(n)) and r["exceptions"] == n - most
            assert left.get(v, 0) == (n - column.count(0.0) if r["dense"] else n - most)
        means = {r["id"]: r["cohort_mean"] for r in scoring.cohort_means(sparse, n, common).collect()}
        for v in rows:
            known = [plain[v, s] for s in range(n) if plain[v, s] is not None]
            assert means[v] == pytest.approx(sum(known) / len(known))


def test_blocks_follow_scores_and_calls(spark):
    """With few scores blocks are wider, with dense calls not; weights go only to blocks in which their tile has calls."""
    few, many = blocked.span_of(16, 1000, 10**6), blocked.span_of(5000, 1000, 10**6)
    assert few == 64 * blocked.SAMPLES and many == blocked.SAMPLES
    assert blocked.span_of(16, 1000 * 10**6, 10**6 - 1) == blocked.SAMPLES and blocked.span_of(1, 10**7, 10**6) * 10**7 // 10**6 <= blocked.CALLS
    # Repeated weights are added in their order: with these sizes another order gives another sum.
    n = 3 * blocked.SAMPLES
    edges = spark.createDataFrame([(0, 7, r, w, 0.5, 0.0) for r, w in ((3, -1e16), (1, 1e16), (2, 1.0), (4, 3.0))], "score_idx long, ordinal long, row_seq long, beta double, mean double, common double")
    calls = spark.createDataFrame([(7, s, 1.0) for s in (0, n - 1)] + [(8, 5, 1.0)], "ordinal long, sample_idx long, dosage double")
    found = {(r["score_idx"], r["sample_idx"]): r["upd"] for r in blocked.products(edges, calls, 1, n - 1, F.floor(F.col("ordinal") / 4), order="row_seq").collect()}
    assert found == {(0, 0): ((1e16 + 1.0) - 1e16) + 3.0, (0, n - 1): ((1e16 + 1.0) - 1e16) + 3.0}


def test_strict_sums_follow_stored_order(spark, monkeypatch):
    """Products are added one by one, by variant and then by row, whatever the batches are; weights are not copied to blocks of samples (finding F1)."""
    import pyarrow as pa

    from additiva.queries import registry

    rng = random.Random(5)
    edges = [(rng.randrange(6), v, r, rng.uniform(-1, 1) * 10 ** rng.randrange(17), 0.3 if v % 4 else None) for v in range(40) for r in rng.sample(range(1000), v % 9 + 1)]
    calls = [(f"v{v}", v, s, rng.choice([0.1, 0.7, 1.9, None])) for v in range(40) for s in rng.sample(range(50), 11)]
    want = {}
    for _, v, s, dosage in sorted(calls, key=lambda c: c[1]):
        for k, _, _, w, mean in sorted((e for e in edges if e[1] == v), key=lambda e: e[2]):
            x = mean if dosage is None else dosage
            if x is not None:
                want[k, s] = want.get((k, s), 0.0) + w * x
    e = spark.createDataFrame([(k, f"v{v}", r, w, m) for k, v, r, w, m in edges], "score_idx long, id string, row_seq long, beta double, mean double").repartition(5)
    c = spark.createDataFrame(calls, "id string, ordinal long, sample_idx long, dosage double").repartition(7)
    for parts, size in ((None, "10000"), (3, "2")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {(r["score_idx"], r["sample_idx"]): r["upd"] for r in scoring.ordered_updates(e, c, "ordinal", "row_seq", parts=parts).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(4, 0.1, [0, 9], [1e16, 1.0]), (4, 0.7, [9, 0, 9], [2.0, -1e16, 0.5]), (6, 1.9, [70_000], [3.0]), (7, 0.5, [0, 1], [1.0, 4.0])]
    batch = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)], names=["sample_idx", "x", "scores", "betas"])
    want = [(0, 4, 1e16 * 0.1 + -1e16 * 0.7), (9, 4, 0.1 + 2.0 * 0.7 + 0.5 * 0.7), (70_000, 6, 3.0 * 1.9), (0, 7, 0.5), (1, 7, 2.0)]
    for products, cells in ((1 << 20, 1 << 22), (1, 1), (3, 1 << 22), (1 << 20, 1)):
        monkeypatch.setattr(scoring, "PRODUCTS", products)
        monkeypatch.setattr(scoring, "CELLS", cells)
        found = [tuple(r.values()) for b in scoring._in_order(iter(batch.to_batches(2))) for r in b.to_pylist()]
        assert found == want
    plan = registry.QUERIES["score_strict_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
