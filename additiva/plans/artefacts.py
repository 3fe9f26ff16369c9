"""Stored indices and fragments: where their tables lie, and that they belong together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from additiva.operators.checks import InputError


def meta_of(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metadata", wholetext=True).collect()))


def same_lineage(spark: SparkSession, *paths: str) -> str:
    found = {meta_of(spark, p)["signature"] for p in paths}
    if len(found) != 1:
        raise InputError("index, support and fragments come from different variant lists")
    return found.pop()


def index_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/aliases")


def rows_of(spark: SparkSession, fragment: str) -> DataFrame:
    schema = "score_idx int, ordinal long, row_seq long, weight double, ref_effect boolean, score_id string, tile_idx long"
    return spark.read.schema(schema).parquet(f"{fragment}/rows")


def quality_of(spark: SparkSession, fragment: str) -> DataFrame:
    return spark.read.parquet(f"{fragment}/quality")


def eligible_scores(spark: SparkSession, fragment: str) -> DataFrame:
    return quality_of(spark, fragment).where("status = 'eligible'")
