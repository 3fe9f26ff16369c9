"""Command line: ``python -m additiva.cli COMMAND --option value``. Any refusal is one line and exit status 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from additiva.operators.checks import InputError
from additiva.plans import commands as c
from additiva.sinks.writers import Progress
from additiva.sources.inputs import read_pfile_list


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="additiva")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, required: str, optional: str = "") -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for o in required.split():
            s.add_argument(f"--{o}", required=True)
        for o in optional.split():
            s.add_argument(f"--{o}")
        s.add_argument("--progress-log")
        s.add_argument("--progress-interval", type=float)
        return s

    add("build-variant-index", "variant-list out", "source-id-column target-id-column strip-target-id-prefix ref-column alt-column block-size")
    add("build-support-index", "index read-freq out", "pvar pvar-list")
    add("compile", "manifest out")
    add("compile-fragment", "manifest index out", "support minimum-reference-fraction")
    add("merge-variant-bits", "variant-bits-list out")
    add("report-fragment-support", "fragment support out")
    add("convert", "scores out")
    add("score", "out", "manifest compiled-catalog fragment-list index pgen pvar psam pfile-list read-freq variant-map score-schema missing-frequency format")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.progress_interval is not None and not a.progress_log:
        raise InputError("a progress interval needs a progress log")
    log = Progress(a.command, a.progress_log, 30.0 if a.progress_interval is None else a.progress_interval)
    try:
        if a.command == "build-variant-index":
            named = {"source": a.source_id_column, "target": a.target_id_column, "strip_prefix": a.strip_target_id_prefix, "ref": a.ref_column, "alt": a.alt_column, "block": int(a.block_size) if a.block_size else None}
            c.build_variant_index(spark, a.variant_list, a.out, progress=log, **{k: v for k, v in named.items() if v})
        elif a.command == "build-support-index":
            c.build_support_index(spark, a.index, a.read_freq, a.out, pvar=a.pvar, pvar_list=a.pvar_list, progress=log)
        elif a.command == "compile":
            c.compile_source_catalog(spark, a.manifest, a.out, progress=log)
        elif a.command == "compile-fragment":
            c.compile_score_fragment(spark, a.manifest, a.index, a.out, support_path=a.support, minimum=float(a.minimum_reference_fraction or 0), progress=log)
        elif a.command == "merge-variant-bits":
            c.merge_variant_bits(spark, a.variant_bits_list, a.out)
        elif a.command == "report-fragment-support":
            c.report_fragment_support(spark, a.fragment, a.support, a.out)
        elif a.command == "convert":
            c.convert_to_parquet(spark, a.scores, a.out)
        else:
            if bool(a.pfile_list) == bool(a.pgen):
                raise InputError("give either pfile-list or pgen, pvar and psam")
            filesets = read_pfile_list(spark, a.pfile_list) if a.pfile_list else [{"PGEN": a.pgen, "PVAR": a.pvar, "PSAM": a.psam}]
            c.score(spark, a.out, filesets, manifest=a.manifest, catalog=a.compiled_catalog, fragment_list=a.fragment_list, index_path=a.index, frequency_path=a.read_freq, variant_map=a.variant_map, score_schema=a.score_schema, policy=a.missing_frequency or "cohort", form=a.format or "wide", progress=log)
    finally:
        log.close()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("additiva").getOrCreate()
    try:
        run(spark, a)
    except (InputError, ValueError, AnalysisException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
