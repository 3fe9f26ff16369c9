"""Containers, the byte matrix, stored tiles and buckets, one pass over inputs, lineage and progress."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from additiva.operators import scoring, stored
from additiva.operators.checks import InputError
from additiva.operators.variants import build_index, signature
from additiva.plans import commands as c
from additiva.queries.stars import Domain
from additiva.sinks import matrix, writers
from additiva.sinks.writers import Progress
from additiva.sources import pgen

DIR = "/root/testdata/sf0.001"


def container(path, mode, dosages, flags=0x40, cut=0):
    """A file of the fixed-width layouts, from 16-bit dosages (65535: missing)."""
    n = dosages.shape[1]
    old = {32768: 0, 65535: 1, 16384: 2, 0: 3}
    out = b"\x6c\x1b" + bytes([mode])
    if mode > 1:
        out += struct.pack("<IIB", *dosages.shape, flags)
    if flags >> 6 == 3:
        out += bytes((len(dosages) + 7) // 8)
    for row in dosages:
        code = [old[int(x)] if mode == 1 else 3 if x == 65535 else (int(x) + 8192) // 16384 for x in row]
        code += [0] * (-n % 4)
        out += bytes(code[k] | code[k + 1] << 2 | code[k + 2] << 4 | code[k + 3] << 6 for k in range(0, len(code), 4))
        if mode > 2:
            out += row.astype("<u2").tobytes()
        if mode == 4:
            out += bytes(2 * n)
    path.write_bytes(out[: len(out) - cut])
    return str(path)


def matrix_of(rows, shape):
    out = np.full(shape, -1.0)
    for r in rows:
        out[r["pgen_variant_idx"]] = -9 if r["common"] is None else r["common"]
        for s, x in r["exceptions"]:
            out[r["pgen_variant_idx"], s] = -9 if x is None else x
    return out


@pytest.mark.parametrize(("mode", "flags"), [(1, 0), (2, 0x40), (2, 0xC0), (3, 0x40), (4, 0xC0)])
def test_containers(spark, tmp_path, mode, flags):
    rng = np.random.default_rng(mode)
    shape = (61, 23)
    usual = rng.choice([0, 16384, 32768, 65535], 61)[:, None]
    dosages = np.where(rng.random(shape) < rng.choice([0.05, 0.7], 61)[:, None], rng.choice([0, 16384, 32768, 65535] if mode < 3 else [0, 16384, 32768, 65535, 77, 20000], shape), usual)
    path = container(tmp_path / "x.pgen", mode, dosages, flags)
    rows = pgen.read_pgen(spark, path, samples=23, range_bytes=10 * pgen.record_width(mode, 23))
    assert rows.rdd.getNumPartitions() == 7 and pgen.counts_of(path, 23) == shape
    found = rows.collect()
    assert np.array_equal(matrix_of(found, shape), np.where(dosages == 65535, -9, dosages / 16384))
    for r in found:
        counts = np.unique(dosages[r["pgen_variant_idx"]], return_counts=True)[1]
        assert r["dense"] == (23 - counts.max() > 6)
        if not r["dense"]:
            assert len(r["exceptions"]) == 23 - counts.max()


def test_single_samples_are_dense(spark, tmp_path):
    (r,) = pgen.read_pgen(spark, container(tmp_path / "x.pgen", 2, np.array([[32768]]))).collect()
    assert r["dense"] and r["common"] == 0 and [tuple(x) for x in r["exceptions"]] == [(0, 2.0)]


def test_containers_are_refused(spark, tmp_path):
    some = np.zeros((5, 9), np.int64)
    bad = tmp_path / "bad.pgen"
    for data, message in ((b"", "no genotype container"), (b"ab\x02", "no genotype container"), (b"\x6c\x1b\x10" + bytes(20), "compressed"), (b"\x6c\x1b\x02" + struct.pack("<IIB", 0, 4, 0), "at least one"), (b"\x6c\x1b\x01" + bytes(9), "no counts")):
        bad.write_bytes(data)
        with pytest.raises(InputError, match=message):
            pgen.counts_of(str(bad))
    with pytest.raises(InputError, match="bytes, not"):
        pgen.counts_of(container(bad, 2, some, cut=1))
    with pytest.raises(InputError, match="9 samples, not 8"):
        pgen.counts_of(container(bad, 2, some), 8)
    with pytest.raises(InputError, match="whole dosages"):
        pgen.encoded(np.array([5]), 2)


@pytest.fixture()
def cohort(tmp_path):
    """Three variants, five samples; v3 has a common dosage of 2, one sample of v2 is missing."""
    files = {
        "c.pvar": "#CHROM\tPOS\tID\tREF\tALT\n1\t1\tv1\tA\tG\n1\t2\tv2\tC\tT\n1\t3\tv3\tG\tA\n", "c.psam": "#FID\tIID\nf\ts1\nf\ts2\nf\ts3\nf\ts4\nf\ts5\n", "freq.tsv": "ID\tREF\tALT\tALT_FREQS\nv1\tA\tG\t0.25\nv2\tC\tT\t0.5\n",
        "w1.tsv": "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\nv1\tG\tA\t2\nv1\tG\tA\t1\nv2\tC\tT\t4\nv3\tA\tG\t8\nv9\tA\tG\t1\nv1\tA\tG\t0\n", "w2.tsv": "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\nv3\tG\tA\t1\n",
        "m.tsv": "SCORE\tPATH\none\tw1.tsv\ntwo\tw2.tsv\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    unit = 16384
    dosages = np.array([[0, 1, 2, 0, 0], [1, 1, 4, 1, 0], [2, 2, 2, 1, 2]]) * unit
    container(tmp_path / "c.pgen", 2, np.where(dosages == 4 * unit, 65535, dosages))
    return tmp_path


def fileset(d, genotypes="c.pgen"):
    return [{"PGEN": f"{d}/{genotypes}", "PVAR": f"{d}/c.pvar", "PSAM": f"{d}/c.psam"}]


#: one: 3 x(v1) + 4 (2 - x(v2)) + 8 x(v3), two: 2 - x(v3); the missing call of v2 is its frequency's 1.
WANT = {0: [20.0, 23.0, 26.0, 12.0, 24.0], 1: [0.0, 0.0, 0.0, 1.0, 0.0]}


def by_score(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["score_idx"], r["sample_idx"])):
        out.setdefault(r["score_idx"], []).append(r["score"])
    return out


def test_score_of_a_container(spark, cohort):
    out = f"{cohort}/out"
    scores = c.score(spark, out, fileset(cohort), manifest=f"{cohort}/m.tsv", frequency_path=f"{cohort}/freq.tsv", form="binary")
    assert by_score(scores.collect()) == WANT
    # What the result is computed from are tables of the shared folder: no input is read again.
    assert scores.inputFiles() and not any(str(cohort) in f for f in scores.inputFiles())
    run = c.meta_of(spark, out)
    assert run["scored_variants"] == 3 and run["weight_edges"] == 5 and run["imputed_values"] == 1 and run["external_frequency_variants"] == 2 and run["cohort_frequency_variants"] == run["missing_frequency_variants"] == 1
    rows = {r["score"]: r for r in spark.read.parquet(f"{out}/score_metadata").collect()}
    names = "input_weights zero_weights duplicate_weights catalog_weights matched_weights missing_variants missing_frequencies scored_weights alt_effects ref_effects ref_intercept".split()
    assert [rows["one"][n] for n in names] == [6, 1, 1, 5, 4, 1, 0, 4, 3, 1, 8.0] and [rows["two"][n] for n in names] == [1, 0, 0, 1, 1, 0, 0, 1, 0, 1, 2.0]
    text = next((cohort / "out" / "score_metadata_text").glob("part-*")).read_text().splitlines()
    assert len(text[0].split("\t")) == 20 and text[0].startswith("INDEX\tSCORE\tINPUT_WEIGHTS") and len(text) == 3
    c.convert_to_parquet(spark, out, f"{cohort}/wide")
    wide = {r["IID"]: (r["FID"], r["one"], r["two"]) for r in spark.read.parquet(f"{cohort}/wide").collect()}
    assert wide == {f"s{k + 1}": ("f", WANT[0][k], WANT[1][k]) for k in range(5)}


def test_score_omits_and_counts(spark, cohort):
    out = f"{cohort}/out"
    scores = c.score(spark, out, fileset(cohort), manifest=f"{cohort}/m.tsv", frequency_path=f"{cohort}/freq.tsv", policy="omit", form="score-major")
    assert by_score(scores.collect()) == {0: [4.0, 7.0, 10.0, 4.0, 8.0], 1: [0.0] * 5}
    run = c.meta_of(spark, out)
    assert (run["omitted_frequency_variants"], run["omitted_frequency_edges"], run["scored_variants"], run["weight_edges"]) == (1, 2, 2, 3)
    rows = {r["score"]: r for r in spark.read.parquet(f"{out}/score_metadata").collect()}
    assert (rows["one"]["missing_frequencies"], rows["one"]["scored_weights"], rows["two"]["ref_intercept"]) == (1, 3, 0.0)


@pytest.mark.parametrize(("file", "text", "message"), [
    ("c.pvar", "#CHROM\tID\tREF\tALT\n1\tv1\tA\tG\n1\tv2\tC\tT\n", "its PVAR 2"), ("c.psam", "#IID\ns1\n", "5 samples, not 1|its PSAM 1"), ("w2.tsv", "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\nv3\tT\tA\t1\n", "two allele pairs|alleles disagree"),
    ("w2.tsv", "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\nv3\tG\tG\t1\n", "equal alleles"), ("w2.tsv", "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\nv3\tG\tA\tx\n", "invalid EFFECT"),
])
def test_score_refuses(spark, cohort, file, text, message):
    (cohort / file).write_text(text)
    with pytest.raises(InputError, match=message):
        c.score(spark, f"{cohort}/out", fileset(cohort), manifest=f"{cohort}/m.tsv")


@pytest.mark.parametrize(("call", "message"), [((7, 0, 1.0), "PVAR lacks"), ((0, 5, 1.0), "PSAM lacks"), ((0, -1, 1.0), "PSAM lacks")])
def test_score_refuses_foreign_calls(spark, cohort, call, message):
    spark.createDataFrame([(0, 1, 1.0), call], "pgen_variant_idx long, sample_idx long, dosage double").write.parquet(f"{cohort}/calls")
    with pytest.raises(InputError, match=message):
        c.score(spark, f"{cohort}/out", fileset(cohort, "calls"), manifest=f"{cohort}/m.tsv")


def test_matrix(spark, tmp_path):
    people = spark.createDataFrame([(10 * k + 3, None, f"i{k}") for k in range(50)], "sample_idx long, fid string, iid string")
    scores = spark.createDataFrame([(k, 10 * s + 3, k + s / 8) for k in (4, 9) for s in range(50)], "score_idx long, sample_idx long, score double")
    path = str(tmp_path / "m")
    matrix.write_matrix(scores, [(9, "nine"), (4, "four")], people, path)
    cells, samples, names, about = matrix.read_matrix(spark, path, range_bytes=96)
    assert cells.rdd.getNumPartitions() >= 9 and names == ["nine", "four"] and about["sample_id_columns"] == ["IID"]
    assert sorted(map(tuple, cells.collect())) == [(j, s, k + s / 8) for j, k in enumerate((9, 4)) for s in range(50)]
    assert sorted((r["row"], r["IID"]) for r in samples.collect()) == [(k, f"i{k}") for k in range(50)]
    part = sorted((tmp_path / "m" / "matrix").glob("part-*"))[-1]
    whole = part.read_bytes()
    for data, message in ((whole[:-1], "bytes, not"), (whole + bytes(8), "bytes, not")):
        part.write_bytes(data)
        with pytest.raises(InputError, match=message):
            matrix.read_matrix(spark, path)
    part.unlink()
    with pytest.raises(InputError, match="has .* bytes, not 800|does not begin"):
        matrix.read_matrix(spark, path)
    for names in ([(9, "x"), (4, "x")], [(9, "IID"), (4, "x")], []):
        with pytest.raises(InputError):
            matrix.write_matrix(scores, names, people, path)
    with pytest.raises(Exception, match="do not follow"):
        matrix.write_matrix(scores.where("sample_idx <> 13"), [(9, "nine"), (4, "four")], people, str(tmp_path / "holes"))


def test_many_scores_make_no_larger_plan(spark, tmp_path):
    """5,000 scores: the plan does not grow with them, and all are written."""
    people = spark.createDataFrame([(k, None, f"i{k}") for k in range(3)], "sample_idx long, fid string, iid string")
    scores = spark.range(5000).crossJoin(people.select("sample_idx")).select(F.col("id").alias("score_idx"), "sample_idx", (F.col("id") + F.col("sample_idx") / 4).alias("score"))
    rows = scoring.arrays(scores, list(range(4999, -1, -1)), people)
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 6000
    names = [f"n{k}" for k in range(5000)]
    writers.write_wide_text(rows, f"{tmp_path}/t", names)
    writers.write_wide_parquet(rows, f"{tmp_path}/p", names)
    lines = [r[0].split("\t") for r in spark.read.text(f"{tmp_path}/t").collect() if r[0].startswith("i")]
    assert {x[0]: (len(x), x[1], x[-1]) for x in lines} == {"i0": (5001, "4999", "0"), "i1": (5001, "4999.25", "0.25"), "i2": (5001, "4999.5", "0.5")}
    assert len(spark.read.parquet(f"{tmp_path}/p").columns) == 5001


def test_tiles_are_pruned(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).alias("score_idx"), F.col("id").alias("ordinal"), F.col("id").alias("row_seq"), F.lit(1.0).alias("weight"), F.lit(False).alias("ref_effect"), F.floor(F.col("id") / 1000).alias("tile_idx"))
    stored.store_by_tile(rows, f"{tmp_path}/rows")
    spark.range(4000).select(F.col("id").alias("ordinal"), F.when(F.col("id") < 1500, 2).otherwise(0).alias("state"), F.floor(F.col("id") / 1000).alias("tile_idx")).write.parquet(f"{tmp_path}/support")
    tiles = stored.tiles_of(spark.read.parquet(f"{tmp_path}/support"), F.col("state") == 2)
    found = stored.in_tiles(spark, f"{tmp_path}/rows", "score_idx long, ordinal long, row_seq long, weight double, ref_effect boolean", tiles)
    assert found.count() == 2000
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    d = Domain(spark, DIR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(500).select((F.col("id") % 3).alias("score_idx"), F.col("id").alias("ordinal"), F.lit(1.0).alias("beta"), F.lit(0.0).alias("mean"))
        e, k = (stored.store_in_buckets(df, f"{tmp_path}/{n}", "ordinal", 4) for n, df in (("e", edges), ("k", d.calls.select("ordinal", "sample_idx", "dosage"))))
        plan = scoring.updates(e, k, "ordinal")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange: that of the sums by (score, sample).
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_lineage(spark):
    rows = [(k, f"s{k}", f"v{k}", "A", "G") for k in range(600)]
    make = lambda r: signature(build_index(spark.createDataFrame(r, "ordinal long, source_id string, target_id string, ref string, alt string"), block=100))
    whole = make(rows)
    assert whole == make(rows[::-1]) and len(whole) == 64
    swapped = [*rows[:300], (300, *rows[301][1:]), (301, *rows[300][1:]), *rows[302:]]
    shifted = [(0, "s0v", "0", "A", "G"), *rows[1:]]
    assert len({whole, make(swapped), make(shifted), make(rows[:-1])}) == 4
    with pytest.raises(InputError, match="too many"):
        make([(1 << 32, "s", "v", "A", "G")])


def test_stored_sums_are_compared(spark, tmp_path):
    """A fragment whose rows do not add up to its stored sums is refused."""
    (tmp_path / "list.tsv").write_text("SOURCE_ID\tTARGET_ID\tREF\tALT\n" + "".join(f"s{k}\tv{k}\tA\tG\n" for k in range(4)))
    (tmp_path / "f.tsv").write_text("ID\tREF\tALT\tALT_FREQS\n" + "".join(f"v{k}\tA\tG\t0.5\n" for k in range(4)))
    (tmp_path / "p.pvar").write_text("#CHROM\tID\tREF\tALT\n" + "".join(f"1\tv{k}\tA\tG\n" for k in range(3)))
    (tmp_path / "w.tsv").write_text("SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\n" + "".join(f"v{k}\tG\tA\t{k + 1}\n" for k in range(4)))
    (tmp_path / "m.tsv").write_text("SCORE\tPATH\none\tw.tsv\n")
    c.build_variant_index(spark, f"{tmp_path}/list.tsv", f"{tmp_path}/index")
    c.build_support_index(spark, f"{tmp_path}/index", f"{tmp_path}/f.tsv", f"{tmp_path}/support", pvar=f"{tmp_path}/p.pvar")
    c.compile_score_fragment(spark, f"{tmp_path}/m.tsv", f"{tmp_path}/index", f"{tmp_path}/frag")
    c.report_fragment_support(spark, f"{tmp_path}/frag", f"{tmp_path}/support", f"{tmp_path}/report")
    rows = c.rows_of(spark, f"{tmp_path}/frag").withColumn("weight", F.col("weight") * 1.0001).collect()
    spark.createDataFrame(rows, c.rows_of(spark, f"{tmp_path}/frag").schema).write.mode("overwrite").partitionBy("tile_idx").parquet(f"{tmp_path}/frag/rows")
    with pytest.raises(InputError, match="stored sums"):
        c.report_fragment_support(spark, f"{tmp_path}/frag", f"{tmp_path}/support", f"{tmp_path}/report2")


def test_progress_between_phases(spark, tmp_path):
    log = Progress("score", f"{tmp_path}/log", interval=0.05)
    with log.watching(spark, "running"):
        spark.range(8).repartition(8).rdd.foreach(lambda _: __import__("time").sleep(0.3))
    log.event("complete")
    log.close()
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert [x["sequence"] for x in lines] == list(range(len(lines))) and sum(x["phase"] == "running" and x["tasks"] > 0 for x in lines) >= 2


def test_an_interval_needs_a_log(spark):
    from additiva import cli

    with pytest.raises(InputError, match="interval"):
        cli.run(spark, cli.parser().parse_args(["merge-variant-bits", "--variant-bits-list", "x", "--out", "y", "--progress-interval", "5"]))


def test_folders_of_parts_are_one_file(spark, tmp_path):
    from additiva.sources import inputs

    (tmp_path / "v").mkdir()
    for k in range(3):
        head = "ID\tREF\tALT\tCHROM\n" if k == 1 else "#CHROM\tID\tREF\tALT\n"
        (tmp_path / "v" / f"part-{k}").write_text(head + "".join(f"v{k}{j}\tA\tG\t1\n" if k == 1 else f"1\tv{k}{j}\tA\tG\n" for j in range(k + 1)))
    rows = inputs.read_pvar(spark, f"{tmp_path}/v").orderBy("pgen_variant_idx").collect()
    assert [(r["pgen_variant_idx"], r["id"], r["chrom"]) for r in rows] == [(0, "v00", "1"), (1, "v10", "1"), (2, "v11", "1"), (3, "v20", "1"), (4, "v21", "1"), (5, "v22", "1")]


def test_listed_containers(spark, tmp_path):
    """Records of their own widths: all codes and lists of one to many groups, against REF, ALT and missing; a file as large as its lists."""
    rng = np.random.default_rng(7)
    n = 30_000
    dosages = np.zeros((40, n), np.int64)
    for k in range(40):
        base, listed = (0, 1, 2, 3)[k % 4], (0, 1, 64, 65, 700, n // 8, n // 8 + 1, n // 2)[k % 8 if k < 32 else 4]
        dosages[k] = base
        who = rng.choice(n, listed, replace=False)
        dosages[k, who] = (base + rng.integers(1, 4, listed)) % 4
    variants = spark.range(40).withColumnRenamed("id", "pgen_variant_idx")
    at, who = np.nonzero(dosages)
    table = [(int(v), int(s), None if dosages[v, s] == 3 else float(dosages[v, s])) for v, s in zip(at[:: 1], who, strict=True)]
    import pandas as pd

    calls = spark.createDataFrame(pd.DataFrame(table, columns=["pgen_variant_idx", "sample_idx", "dosage"])).replace(float("nan"), None)
    path = str(tmp_path / "listed")
    pgen.write_pgen(calls, variants, n, path, pgen.VARIABLE)
    assert pgen.counts_of(path) == (40, n)
    rows = pgen.read_pgen(spark, path, range_bytes=1 << 14)
    assert rows.rdd.getNumPartitions() > 4
    found = rows.collect()
    assert np.array_equal(matrix_of(found, dosages.shape), np.where(dosages == 3, -9, dosages))
    for r in found:
        counts = np.bincount(dosages[r["pgen_variant_idx"]], minlength=4)
        assert r["dense"] == (n - counts.max() > 3 * (n // 8))
        assert len(r["exceptions"]) == n - (counts[0] if r["dense"] else counts.max())
    # A list takes some bytes a listed sample: a thousand variants of a large cohort with one call each stay small.
    few = spark.range(1000).select(F.col("id").alias("pgen_variant_idx"), (F.col("id") * 900).alias("sample_idx"), F.lit(1.0).alias("dosage"))
    pgen.write_pgen(few, few.select("pgen_variant_idx"), 1_000_000, f"{path}2", pgen.VARIABLE)
    assert sum(f.stat().st_size for f in (tmp_path / "listed2").glob("*.pgen")) < 20_000
    assert sorted((r["pgen_variant_idx"], r["exceptions"][0]["sample_idx"]) for r in pgen.read_pgen(spark, f"{path}2").collect()) == [(k, 900 * k) for k in range(1000)]
    with pytest.raises(InputError, match="type 0x2"):
        pgen.record_list(2, np.zeros(9, np.uint8), 9)


def stages_of(spark, run) -> int:
    """Tasks of the widest shuffle stage that ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"parts-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s)


def test_parts_follow_the_rows(spark, monkeypatch):
    """Adaptive execution must not merge the parts that keep a task's rows bounded (findings F10 to F17)."""
    from additiva.queries import registry

    monkeypatch.setattr(scoring, "PART_ROWS", 100)
    d = Domain(spark, "/root/testdata/sf0.001")
    assert d.parts == -(-d.table("lineitem").count() // 100) > 50
    assert stages_of(spark, lambda: registry.flagship(d).write.format("noop").mode("overwrite").save()) >= d.parts


def test_calls_are_not_dealt_again(spark):
    """Calls that lie by variant in as many parts meet their weights without another shuffle of them."""
    d = Domain(spark, "/root/testdata/sf0.001")
    for key in ("id", "ordinal"):
        calls = d.calls_by(key)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (calls, scoring.dealt(calls, d.parts, key))]
        assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning")


def test_matrix_is_dealt_without_a_sample(spark, tmp_path, monkeypatch):
    """Each part of the matrix has an equal range of places, and the scores are computed once (finding F12)."""
    monkeypatch.setattr(scoring, "PART_ROWS", 7)
    people = spark.range(10).select(F.col("id").alias("sample_idx"), F.lit(None).cast("string").alias("fid"), F.col("id").cast("string").alias("iid"))
    scores = spark.range(20).select((F.col("id") % 2).alias("score_idx"), F.floor(F.col("id") / 2).alias("sample_idx"), F.col("id").cast("double").alias("score"))
    matrix.write_matrix(scores, [(0, "a"), (1, "b")], people, f"{tmp_path}/m")
    assert [(first, n) for _, first, n in matrix.parts_of(f"{tmp_path}/m/matrix")] == [(0, 7), (7, 7), (14, 6)]
    cells = matrix.read_matrix(spark, f"{tmp_path}/m")[0].collect()
    assert sorted((r["column"], r["row"], r["score"]) for r in cells) == sorted((k % 2, k // 2, float(k)) for k in range(20))


def test_streamed_shards_follow_the_rows(spark, tmp_path, monkeypatch):
    """A shard is many files, so its tasks follow the rows; batches add up without state in memory (finding F2)."""
    from additiva.queries import registry
    from additiva.streaming import shards

    monkeypatch.setattr(scoring, "PART_ROWS", 1000)
    monkeypatch.setattr(shards, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    d = Domain(spark, "/root/testdata/sf0.001")
    found = registry.score_streamed_shards(d).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, registry.flagship(d).collect()))
    assert d.parts > 3 and len(list((tmp_path / "stream" / "calls").glob("part-*"))) == d.parts
    assert sorted(f.name for f in (tmp_path / "stream" / "changed").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    assert not (tmp_path / "stream" / "state" / "state").exists()


@pytest.mark.parametrize("calls", [[], [(1, 0, 2.0), (1, 2, None), (2, 1, 1.0), (3, 7, 1.0), (9, 0, 1.0)]])
def test_streamed_shards_without_parts(spark, calls):
    """Few calls or none, a sample outside the cohort, a variant and a score without weights, repeated weights."""
    from additiva.streaming.shards import score_stream_to_table

    edges = spark.createDataFrame([(0, 1, 2.0, 0.5, 0.25), (0, 1, 1.0, 0.0, 0.25), (1, 2, 4.0, 1.0, 0.5), (1, 3, 8.0, 0.0, 0.5), (7, 3, 8.0, 0.0, 0.5)], "score_idx long, id long, beta double, intercept double, mean double")
    out = score_stream_to_table(spark, edges, spark.createDataFrame(calls, "id long, sample_idx long, dosage double"), spark.range(3).toDF("sample_idx"), spark.range(3).toDF("score_idx"), 2)
    moved = {(0, 0): 6.0, (0, 2): 0.75, (1, 1): 4.0} if calls else {}
    assert {(r["score_idx"], r["sample_idx"]): r["score"] for r in out.collect()} == {(k, s): (0.5, 1.0, 0.0)[k] + moved.get((k, s), 0.0) for k in range(3) for s in range(3)}


def test_many_records_are_as_single_ones():
    """Lists of many variants at once have the bytes and the rows of one at a time; what is no plain list is left to that."""
    rng = np.random.default_rng(11)
    for trial in range(60):
        samples, base = int(rng.choice([9, 70, 5000, 70_000, 20_000_000])), int(rng.choice([0, 0, 2, 3]))
        lists = [np.unique(rng.integers(0, samples, min(samples // 8, n))) for n in rng.choice([0, 1, 2, 3, 63, 64, 65, 128, 129, 500], rng.integers(1, 20))]
        codes = [(base + rng.integers(1, 4, len(w))) % 4 for w in lists]
        kinds, records = zip(*(pgen.listed_record(w, c, base, samples) for w, c in zip(lists, codes, strict=True)), strict=True)
        data, places = np.frombuffer(b"".join(records), np.uint8), np.append(0, np.cumsum([len(r) for r in records]))
        if not base:
            out, ends = pgen.listed_records(np.array([len(w) for w in lists]), np.concatenate(lists), np.concatenate(codes), samples)
            assert out.tobytes() == data.tobytes() and ends.tolist() == places.tolist()
        common, dense, counts, who, code = pgen.listed_rows(np.array(kinds), data, places, samples)
        want = [pgen.listed_row(k, np.frombuffer(r, np.uint8), samples) for k, r in zip(kinds, records, strict=True)]
        assert [(None if c == 3 else c, d, n) for c, d, n in zip(common.tolist(), dense.tolist(), counts.tolist(), strict=True)] == [(w[0], w[1], len(w[2])) for w in want]
        assert np.array_equal(who, np.concatenate([w[2] for w in want])) and np.array_equal(code, np.concatenate([w[3] for w in want]))
    whole = np.frombuffer(pgen.listed_record(np.arange(0, 4000, 20), np.ones(200, int), 0, 4000)[1], np.uint8)
    assert pgen.listed_rows(np.array([0]), whole, np.array([0, len(whole)]), 4000) is None
    for cut in range(len(whole)):
        assert pgen.listed_rows(np.array([4]), whole[:cut], np.array([0, cut]), 4000) is None
    swapped = whole.copy()
    swapped[-3:] = 0
    with pytest.raises(InputError, match="not in order"):
        pgen.listed_rows(np.array([4]), swapped, np.array([0, len(swapped)]), 4000)


def test_shards_and_joins_spare_the_driver(spark, monkeypatch):
    """Shards follow the lines and are a task each, containers are read once, and variants beyond the bound are not broadcast (finding F3)."""
    from additiva.queries import files, registry, stars

    monkeypatch.setattr(scoring, "PART_ROWS", 1000)
    d = Domain(spark, DIR)
    assert 1 < files.containers(d)[0].rdd.getNumPartitions() <= d.parts
    assert "BatchScan pgen" not in files.score_pgen(d)._jdf.queryExecution().executedPlan().toString()
    spread = lambda: [line for line in registry.ordinal_edges(Domain(spark, DIR))._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin [ordinal" in line]
    assert spread()
    monkeypatch.setattr(stars, "BROADCAST_ROWS", 10)
    assert not spread()
