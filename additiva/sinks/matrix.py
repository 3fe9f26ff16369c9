"""The score matrix as plain bytes: little-endian doubles, score after score, in part files that byte ranges are read from.

A record is eight bytes at place (score * samples + sample). Rows are range-partitioned by that place, so each task writes one
part file whose name says the first place and the number of records; places must follow each other, and after all tasks are
done the driver moves the parts to their names and checks that together they are the whole matrix. Readers plan from names and
sizes only and cut parts into ranges of ``RANGE_BYTES``, so neither side holds more than a buffer.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from additiva.functions.shared import checkpointed
from additiva.operators import scoring
from additiva.operators.checks import InputError
from additiva.sources.pgen import _place

RANGE_BYTES, BUFFER_BYTES = 64 << 20, 8 << 20
_PART = re.compile(r"part-(\d{18})-(\d+)\.f64")
SCHEMA = "place long, score double"


def parts_of(path: str) -> list[tuple[str, int, int]]:
    """(name, first place, records) in order; each part has the size that its name says."""
    system, folder = _place(path)
    out = []
    for f in system.get_file_info(fs.FileSelector(folder)):
        m = _PART.fullmatch(f.base_name)
        if m:
            first, n = int(m[1]), int(m[2])
            if f.size != 8 * n:
                raise InputError(f"{path}/{f.base_name} has {f.size} bytes, not {8 * n}")
            out.append((f.base_name, first, n))
    return sorted(out, key=lambda x: x[1])


def clear(path: str) -> None:
    """Takes away the parts of an earlier run."""
    system, folder = _place(path)
    if system.get_file_info(folder).type == fs.FileType.Directory:
        for name, _, _ in parts_of(path):
            system.delete_file(posixpath.join(folder, name))


def check_whole(path: str, records: int) -> None:
    """The parts follow each other and are ``records`` records together."""
    at = 0
    for name, first, n in parts_of(path):
        if first != at:
            raise InputError(f"{path}/{name} does not begin at {at}")
        at += n
    if at != records:
        raise InputError(f"{path} has {8 * at} bytes, not {8 * records}")


class _Range(InputPartition):
    def __init__(self, name: str, first: int, begin: int, end: int) -> None:
        self.name, self.first, self.begin, self.end = name, first, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], max(8, int(options.get("rangebytes", RANGE_BYTES))) // 8

    def partitions(self) -> list[InputPartition]:
        return [_Range(name, first, a, min(a + self.step, n)) for name, first, n in parts_of(self.path) for a in range(0, n, self.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, folder = _place(self.path)
        with system.open_input_file(posixpath.join(folder, partition.name)) as f:
            f.seek(8 * partition.begin)
            for a in range(partition.begin, partition.end, BUFFER_BYTES // 8):
                n = min(BUFFER_BYTES // 8, partition.end - a)
                place = np.arange(partition.first + a, partition.first + a + n)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.frombuffer(f.read(8 * n), "<f8"))], names=["place", "score"])


@dataclass
class _Part(WriterCommitMessage):
    temporary: str
    first: int
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part | None:
        system, folder = _place(self.path)
        temporary, out, first, n = f".{uuid.uuid4().hex}", None, 0, 0
        for b in iterator:
            if not b.num_rows:
                continue
            place, score = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            if out is None:
                system.create_dir(folder, recursive=True)
                out, first = system.open_output_stream(posixpath.join(folder, temporary)), int(place[0])
            if not np.array_equal(place, np.arange(first + n, first + n + len(place))):
                raise InputError(f"places after {first + n} do not follow each other")
            out.write(score.astype("<f8").tobytes())
            n += len(place)
        if out is None:
            return None
        out.close()
        return _Part(temporary, first, n)

    def commit(self, messages: list[_Part | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m:
                system.move(posixpath.join(folder, m.temporary), posixpath.join(folder, f"part-{m.first:018d}-{m.records}.f64"))

    def abort(self, messages: list[_Part | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m:
                system.delete_file(posixpath.join(folder, m.temporary))


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "score-matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in order of ``column``: partitions are sorted ranges, so only their sizes are gathered.

    The sorted ranges are checkpointed, as the bounds of ranges are sampled anew on each run.
    """
    ordered = checkpointed(df.repartitionByRange(column).sortWithinPartitions(column))
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, shifts = 0, []
    for part in sorted(sizes):
        shifts.append((part, before - (part << 33)))
        before += sizes[part]
    table = df.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def write_matrix(scores: DataFrame, names: list[tuple[int, str]], samples: DataFrame, path: str) -> None:
    """Writes ``matrix``, ``samples`` (tab-separated, in order), ``names`` and ``description`` below ``path``.

    ``scores`` are (score_idx, sample_idx, score), a row for each score of ``names`` and each sample.
    """
    spark = scores.sparkSession
    if not names:
        raise InputError("no scores")
    ids = ["fid", "iid"] if not samples.where("fid IS NOT NULL").isEmpty() else ["iid"]
    overlap = {c.upper() for c in ids} & {n for _, n in names}
    if overlap or len({n for _, n in names}) < len(names):
        raise InputError(f"score names are not unique or those of sample columns: {sorted(overlap)}")
    people = numbered(samples.select("sample_idx", *ids), "sample_idx", "row")
    n = people.count()
    order = spark.createDataFrame([(k, idx) for k, (idx, _) in enumerate(names)], "column long, score_idx long")
    placed = scores.join(F.broadcast(order), "score_idx").join(people.select("sample_idx", "row"), "sample_idx").select((F.col("column") * n + F.col("row")).alias("place"), "score")
    spark.dataSource.register(MatrixSource)
    clear(f"{path}/matrix")
    # Every place is there once, so equal ranges need no sample of the scores, which would compute them twice.
    cells = n * len(names)
    step = -(-cells // scoring.parts_of(cells)) or 1
    parts = max(1, -(-cells // step))
    placed.repartitionById(parts, F.floor(F.col("place") / step).cast("int")).sortWithinPartitions("place").write.format("score-matrix").option("path", f"{path}/matrix").mode("append").save()
    check_whole(f"{path}/matrix", n * len(names))
    people.sortWithinPartitions("row").select("row", *(F.col(c).alias(c.upper()) for c in ids)).write.mode("overwrite").parquet(f"{path}/samples")
    spark.createDataFrame([(k, x) for k, (_, x) in enumerate(names)], "column long, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    about = {"dtype": "float64", "byte_order": "little-endian", "matrix_layout": "score-major", "sample_rows": n, "score_columns": len(names), "sample_id_columns": [c.upper() for c in ids]}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def read_matrix(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, list[str], dict]:
    """((column, row, score), samples (row and IDs), names, description). Layout, sizes, counts and names are checked first."""
    about = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/description", wholetext=True).collect()))
    for key, value in (("dtype", "float64"), ("byte_order", "little-endian"), ("matrix_layout", "score-major")):
        if about.get(key) != value:
            raise InputError(f"{path}: {key} is not {value}")
    n, k, ids = about["sample_rows"], about["score_columns"], about["sample_id_columns"]
    if n < 1 or k < 1 or not ids:
        raise InputError(f"{path}: no samples, scores or sample columns")
    check_whole(f"{path}/matrix", n * k)
    samples = spark.read.parquet(f"{path}/samples")
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("column").collect()]
    if samples.count() != n or len(names) != k:
        raise InputError(f"{path}: sample or score count differs from the description")
    if len(set(names)) < k or set(names) & set(ids):
        raise InputError(f"{path}: sample and score columns overlap or repeat")
    spark.dataSource.register(MatrixSource)
    rows = spark.read.format("score-matrix").option("path", f"{path}/matrix").option("rangeBytes", str(range_bytes)).load()
    return rows.select(F.floor(F.col("place") / n).alias("column"), (F.col("place") % n).alias("row"), "score"), samples, names, about
