"""Golden cases: small cohorts with values worked out by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from additiva.operators.checks import InputError
from additiva.operators.variants import aliases_of, build_index
from additiva.plans import commands as c
from additiva.sinks.writers import Progress
from additiva.sources import inputs

# The golden inputs and results of FIXTURES.md, cases G1 to G21, as the results must match them.
VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4\n"
V1 = "1\t100\tv1\tA\tG\t.\tPASS\t.\tGT\t0/0\t0/1\t1/1\t./.\n"
V2 = "2\t200\tv2\tC\tT\t.\tPASS\t.\tGT\t1/1\t1/1\t0/1\t1/1\n"
FREQ = "#CHROM\tID\tREF\tALT\tREF_CT\tALT_CTS\tOBS_CT\n1\tv1\tA\tG\t5\t1\t6\n2\tv2\tC\tT\t0\t8\t8\n"
WEIGHTS = "SNP\tEFFECT_ALLELE\tOTHER_ALLELE\tEFFECT_ALLELE_WEIGHT\n"


@pytest.fixture()
def cohort(tmp_path):
    files = {
        "all.vcf": VCF + V1 + V2, "one.vcf": VCF + V1, "two.vcf": VCF + V2,
        "all.pvar": "##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t100\tv1\tA\tG\n2\t200\tv2\tC\tT\n", "one.pvar": "#CHROM\tPOS\tID\tREF\tALT\n1\t100\tv1\tA\tG\n", "two.pvar": "#CHROM\tPOS\tID\tREF\tALT\n2\t200\tv2\tC\tT\n",
        "all.psam": "#IID\ns1\ns2\ns3\ns4\n", "freq.tsv": FREQ,
        "score1.tsv": WEIGHTS + "v1\tG\tA\t2\nv2\tC\tT\t3\n", "score2.tsv": WEIGHTS + "v1\tA\tG\t1\n", "manifest.tsv": "SCORE\tPATH\nscore1\tscore1.tsv\nscore2\tscore2.tsv\n",
        "list.tsv": "SOURCE_ID\tTARGET_ID\tREF\tALT\ns:v1\tv1\tA\tG\ns:v2\tv2\tC\tT\ns:missing\tmissing\tA\tC\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def fileset(d, name="all"):
    return {"PGEN": f"{d}/{name}.vcf", "PVAR": f"{d}/{name}.pvar", "PSAM": f"{d}/all.psam"}


def values(scores):
    out = {}
    for r in scores.orderBy("score_idx", "sample_idx").collect():
        out.setdefault(r["score_idx"], []).append(r["score"])
    return out


G1 = {0: [0, 2, 7, 2 / 3], 1: [2, 1, 0, 5 / 3]}


def near(found, want):
    assert found.keys() == want.keys()
    for k, xs in want.items():
        assert found[k] == pytest.approx(xs, abs=1e-12)


@pytest.mark.parametrize("parts", [["all"], ["one", "two"]])
def test_single_and_sharded(spark, cohort, parts):
    out = c.score(spark, f"{cohort}/out", [fileset(cohort, p) for p in parts], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/freq.tsv")
    near(values(out), G1)
    lines = [line for f in sorted((cohort / "out/scores").glob("*.gz")) for line in gzip.open(f, "rt").read().splitlines()]
    assert lines[0] == "IID\tscore1\tscore2" and "s3\t7\t0" in lines
    last = next(x for x in lines if x.startswith("s4")).split("\t")
    assert [float(x) for x in last[1:]] == pytest.approx([2 / 3, 5 / 3], abs=1e-12)


def test_omit_and_error(spark, cohort):
    (cohort / "some.tsv").write_text("".join(FREQ.splitlines(True)[:2]))
    out = c.score(spark, f"{cohort}/out", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/some.tsv", policy="omit")
    near(values(out), {0: [0, 2, 4, 2 / 3], 1: G1[1]})
    with pytest.raises(InputError, match="no frequency row for scored variant.*v2"):
        c.score(spark, f"{cohort}/err", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/some.tsv", policy="error")
    assert not (cohort / "err").exists()


def test_swapped_frequency_alleles(spark, cohort):
    (cohort / "swapped.tsv").write_text(FREQ.replace("v1\tA\tG", "v1\tG\tA"))
    with pytest.raises(InputError, match="disagree"):
        c.score(spark, f"{cohort}/out", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/swapped.tsv")


def test_map_and_compiled_catalog(spark, cohort):
    for k in (1, 2):
        p = cohort / f"score{k}.tsv"
        p.write_text(p.read_text().replace("v1", "source-v1").replace("v2", "source-v2"))
    (cohort / "map.tsv").write_text("SOURCE_ID\tTARGET_ID\nsource-v1\tv1\nsource-v2\tv2\n")
    options = {"variant_map": f"{cohort}/map.tsv", "frequency_path": f"{cohort}/freq.tsv"}
    near(values(c.score(spark, f"{cohort}/a", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", **options)), G1)
    log = Progress("compile", f"{cohort}/log.jsonl")
    c.compile_source_catalog(spark, f"{cohort}/manifest.tsv", f"{cohort}/catalog", progress=log)
    log.close()
    lines = [json.loads(x) for x in (cohort / "log.jsonl").read_text().splitlines()]
    assert [x["sequence"] for x in lines] == list(range(len(lines))) and lines[-1]["phase"] == "complete" and lines[-1]["weights"] == 3
    near(values(c.score(spark, f"{cohort}/b", [fileset(cohort)], catalog=f"{cohort}/catalog", form="score-major", **options)), G1)
    c.convert_to_parquet(spark, f"{cohort}/b", f"{cohort}/wide")
    wide = spark.read.parquet(f"{cohort}/wide")
    assert wide.columns == ["IID", "score1", "score2"] and wide.count() == 4


def test_filtered_pvar_keeps_row_numbers(spark, cohort):
    (cohort / "m.tsv").write_text("SCORE\tPATH\nx\tx.tsv\n")
    (cohort / "x.tsv").write_text(WEIGHTS + "v2\tC\tT\t3\n")
    near(values(c.score(spark, f"{cohort}/out", [fileset(cohort)], manifest=f"{cohort}/m.tsv", frequency_path=f"{cohort}/freq.tsv")), {0: [0, 0, 3, 0]})
    ids = spark.createDataFrame([("v2",)], "id string")
    assert [tuple(r) for r in inputs.read_pvar(spark, f"{cohort}/all.pvar", ids).collect()] == [(1, "2", "v2", "C", "T")]


@pytest.fixture()
def compiled(spark, cohort):
    (cohort / "f1.tsv").write_text(WEIGHTS + "s:v1\tG\tA\t2\nv2\tC\tT\t3\nmissing\tA\tC\t5\n")
    (cohort / "f2.tsv").write_text(WEIGHTS + "v1\tA\tG\t1\n")
    (cohort / "fm.tsv").write_text("SCORE_ID\tCOLUMN_NAME\tPATH\nsource:score1\tscore1\tf1.tsv\nsource:score2\tscore2\tf2.tsv\n")
    (cohort / "one-freq.tsv").write_text("".join(FREQ.splitlines(True)[:2]))
    c.build_variant_index(spark, f"{cohort}/list.tsv", f"{cohort}/index")
    c.build_support_index(spark, f"{cohort}/index", f"{cohort}/one-freq.tsv", f"{cohort}/support", pvar=f"{cohort}/all.pvar")
    c.compile_score_fragment(spark, f"{cohort}/fm.tsv", f"{cohort}/index", f"{cohort}/fragment", support_path=f"{cohort}/support")
    (cohort / "fl.tsv").write_text("FRAGMENT\nfragment\n")
    return cohort


def test_fragments(spark, compiled):
    d = compiled
    states = {r["ordinal"]: r["state"] for r in spark.read.parquet(f"{d}/support/states").collect()}
    assert states == {0: 2, 1: 1, 2: 0}
    q = {r["score_id"]: r for r in c.quality_of(spark, f"{d}/fragment").collect()}["source:score1"]
    assert (q["catalog_weights"], q["reference_supported_weights"], q["reference_missing_variant_weights"], q["reference_missing_frequency_weights"]) == (3, 1, 1, 1)
    out = c.score(spark, f"{d}/out", [fileset(d)], fragment_list=f"{d}/fl.tsv", index_path=f"{d}/index", frequency_path=f"{d}/one-freq.tsv")
    near(values(out), {0: [0, 2, 4, 2 / 3], 1: G1[1]})
    (d / "schema.tsv").write_text("SCORE_ID\tCOLUMN_NAME\nsource:score2\trenamed\n")
    out = c.score(spark, f"{d}/out2", [fileset(d)], fragment_list=f"{d}/fl.tsv", index_path=f"{d}/index", frequency_path=f"{d}/one-freq.tsv", score_schema=f"{d}/schema.tsv", form="parquet")
    near(values(out), {0: G1[1]})
    assert spark.read.parquet(f"{d}/out2/scores").columns == ["IID", "renamed"]


def test_screen_bits_and_report(spark, compiled):
    d = compiled
    c.compile_score_fragment(spark, f"{d}/fm.tsv", f"{d}/index", f"{d}/screened", support_path=f"{d}/support", minimum=0.5)
    status = {r["score_id"]: r["status"] for r in c.quality_of(spark, f"{d}/screened").collect()}
    assert status == {"source:score1": "excluded_low_reference_coverage", "source:score2": "eligible"}
    (d / "bl.tsv").write_text("VARIANT_BITS\nfragment\nscreened\n")
    assert c.merge_variant_bits(spark, f"{d}/bl.tsv", f"{d}/merged") == 1
    report = {r["score_id"]: r for r in c.report_fragment_support(spark, f"{d}/fragment", f"{d}/support", f"{d}/report").collect()}
    assert report["source:score1"]["target_available_fraction"] == 1 and report["source:score1"]["reference_abs_weight"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        c.merge_variant_bits(spark, f"{d}/bl.tsv", f"{d}/merged")


def test_option_rules(spark, cohort):
    for options in ({}, {"manifest": "a", "catalog": "b"}, {"manifest": "a", "index_path": "b"}, {"fragment_list": "a", "index_path": "i", "variant_map": "b"}, {"manifest": "a", "policy": "omit"}, {"manifest": "a", "form": "x"}):
        with pytest.raises(InputError):
            c.score(spark, f"{cohort}/out", [fileset(cohort)], **options)


@pytest.mark.parametrize(
    ("file", "text", "message"),
    [
        ("score1.tsv", WEIGHTS + "v1\tG\tA\tx\n", "invalid EFFECT"),
        ("score1.tsv", WEIGHTS + "v1\tG\tA\n", "short row"),
        ("score1.tsv", WEIGHTS + "v1\tG\tG\t1\n", "equal alleles"),
        ("score1.tsv", WEIGHTS + "v1\tG\tA\t1\nv1\tG\tC\t1\n", "two allele pairs"),
        ("score1.tsv", "SNP\tSNP\n", "twice"),
        ("score2.tsv", WEIGHTS + "v1\tA\tC\t1\n", "pairs|disagree"),
        ("all.pvar", "#CHROM\tID\tREF\tALT\n1\tv1\tA\tG\n1\tv1\tA\tG\n", "two PVAR rows"),
        ("freq.tsv", FREQ + "1\tv1\tA\tG\t5\t1\t6\n", "two frequency rows"),
        ("manifest.tsv", "SCORE\tPATH\na\tscore1.tsv\na\tscore2.tsv\n", "repeated"),
    ],
)
def test_bad_inputs(spark, cohort, file, text, message):
    (cohort / file).write_text(text)
    with pytest.raises(InputError, match=message):
        c.score(spark, f"{cohort}/out", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/freq.tsv")


def test_bad_rows_that_are_no_error(spark, cohort):
    """Zero weights and unknown variants are not validated further."""
    (cohort / "score2.tsv").write_text(WEIGHTS + "v1\tA\tG\t1\nv1\tX\tX\t0\nother\tA\tC\t4\n")
    near(values(c.score(spark, f"{cohort}/out", [fileset(cohort)], manifest=f"{cohort}/manifest.tsv", frequency_path=f"{cohort}/freq.tsv")), G1)


def test_samples_must_agree(spark, cohort):
    (cohort / "other.psam").write_text("#IID\ns1\ns3\ns2\ns4\n")
    with pytest.raises(InputError, match="samples differ"):
        c.score(spark, f"{cohort}/out", [fileset(cohort, "one"), {**fileset(cohort, "two"), "PSAM": f"{cohort}/other.psam"}], manifest=f"{cohort}/manifest.tsv")


def test_index_aliases_and_prefix(spark):
    rows = spark.createDataFrame([(0, "a", "p:a", "A", "G"), (1, "b", "p:b2", "C", "T"), (2, "x", "p:y", "G", "A")], "ordinal long, source_id string, target_id string, ref string, alt string")
    index = build_index(rows, "p:", 2)
    assert sorted((r["alias"], r["ordinal"]) for r in aliases_of(index).collect()) == [("a", 0), ("b", 1), ("b2", 1), ("x", 2), ("y", 2)]
    assert [r["block"] for r in index.orderBy("ordinal").collect()] == [0, 0, 1]
    with pytest.raises(InputError, match="alias of two"):
        aliases_of(build_index(rows.withColumn("source_id", F.lit("b2")), "p:", 2))
    with pytest.raises(InputError, match="prefix"):
        build_index(rows, "q:")


def test_codecs_and_lists(spark, cohort):
    with gzip.open(cohort / "z.pvar.gz", "wt") as f:
        f.write((cohort / "all.pvar").read_text().replace("\n", "\r\n"))
    assert [r["id"] for r in inputs.read_pvar(spark, f"{cohort}/z.pvar.gz").collect()] == ["v1", "v2"]
    import zstandard

    (cohort / "freq.zst").write_bytes(zstandard.ZstdCompressor().compress(FREQ.encode()))
    from additiva.operators.frequency import read_frequencies

    means = {r["id"]: r["alt_dosage_mean"] for r in read_frequencies(spark, f"{cohort}/freq.zst").collect()}
    assert means == {"v1": pytest.approx(1 / 3), "v2": 2.0}
    (cohort / "pl.tsv").write_text("PGEN\tPVAR\tPSAM\nall.vcf\tsub/../all.pvar\t/x/all.psam\n")
    assert inputs.read_pfile_list(spark, f"{cohort}/pl.tsv") == [{"PGEN": f"{cohort}/all.vcf", "PVAR": f"{cohort}/all.pvar", "PSAM": "/x/all.psam"}]
