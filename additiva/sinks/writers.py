"""Writers: wide text, wide and score-major Parquet, little-endian matrix, tables, run metadata, progress log.

Tables are written by Spark's committer, so a failed run leaves no half-written result behind. Build commands refuse
existing outputs, scoring overwrites (``mode``).
"""

from __future__ import annotations

import json
import os
import resource
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from additiva.functions.shared import stored
from additiva.functions.values import general17
from additiva.operators.scoring import parts_of

REFUSE, OVERWRITE = "errorifexists", "overwrite"


def write_table(df: DataFrame, path: str, mode: str = REFUSE, parts: int | None = None) -> None:
    """Tab-separated text with a header."""
    (df.coalesce(parts) if parts else df).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_wide_text(rows: DataFrame, path: str, names: list[str], mode: str = OVERWRITE) -> None:
    """[FID] IID and one column a score, in the cohort's order, gzip-compressed; FID only if some sample has one.

    ``rows`` have an array ``scores`` in the order of ``names`` (``scoring.arrays``). Range partitions keep the order over the
    part files without a single task; numbers of 17 digits are spelled in Python, as Spark spells them otherwise.
    """
    ids = ["fid", "iid"] if not rows.where("fid IS NOT NULL").isEmpty() else ["iid"]
    header = "\t".join([*(c.upper() for c in ids), *names])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [header]
        for b in batches:
            texts = [["" if x is None else x for x in b.column(k).to_pylist()] for k in range(len(ids))]
            numbers = (["" if x is None else general17(x) for x in row or [None] * len(names)] for row in b.column(len(ids)).to_pylist())
            out = ["\t".join([*who, *row]) for *who, row in zip(*texts, numbers, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(first + out, pa.string())], names=["value"])
                first = []

    ordered = rows.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx").select(*ids, "scores")
    ordered.mapInArrow(lines, "value string").write.mode(mode).option("compression", "gzip").text(path)


def write_score_major(scores: DataFrame, path: str, mode: str = OVERWRITE) -> None:
    """Long Parquet in (score, sample) order: a score's samples lie together. The scores are stored first, as the ranges' bounds are sampled."""
    once = stored(scores)
    once.repartitionByRange(parts_of(once.count()), "score_idx", "sample_idx").sortWithinPartitions("score_idx", "sample_idx").write.mode(mode).parquet(path)


def write_wide_parquet(rows: DataFrame, path: str, names: list[str], mode: str = OVERWRITE, row_group_bytes: int = 4096 * 1024) -> None:
    """Sample rows with named score columns, zstd, dictionary only on the ID columns. Arrays become columns inside tasks."""
    ids = ["fid", "iid"] if not rows.where("fid IS NOT NULL").isEmpty() else ["iid"]

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(len(ids)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(ids))), *(pa.array(numbers[:, k].copy()) for k in range(len(names)))], names=[*(c.upper() for c in ids), *names])

    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    schema = ", ".join([*(f"{c.upper()} string" for c in ids), *(f"{quoted(n)} double" for n in names)])
    ordered = rows.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx").select(*ids, "scores").mapInArrow(columns, schema)
    out = ordered.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary", "false")
    for c in ids:
        out = out.option(f"parquet.enable.dictionary#{c.upper()}", "true")
    out.parquet(path)


def metadata_row(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False, indent=2, sort_keys=False)


def write_metadata(spark, values: dict, path: str, mode: str = OVERWRITE) -> None:
    """Run metadata as one JSON text, on whatever file system the path names."""
    spark.createDataFrame([(metadata_row(values),)], "value string").coalesce(1).write.mode(mode).text(path)


class Progress:
    """JSON lines with a contiguous sequence. ``maybe`` writes only if the interval has passed since the last line; ``watching``
    does so from the status of running jobs."""

    def __init__(self, operation: str, path: str | None = None, interval: float = 30.0) -> None:
        if interval <= 0:
            raise ValueError("the interval must be positive")
        self.operation, self.interval, self.sequence, self.began, self.last = operation, interval, 0, time.time(), 0.0
        self.file = open(path, "w", encoding="utf-8") if path else None  # noqa: SIM115
        self.lines: list[dict] = []
        self.lock = threading.Lock()

    def event(self, phase: str, **details) -> None:
        with self.lock:
            self._write(phase, details)

    def _write(self, phase: str, details: dict) -> None:
        now = time.time()
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        line = {"schema_version": 1, "sequence": self.sequence, "timestamp_unix_ms": int(now * 1000), "elapsed_ms": int((now - self.began) * 1000), "operation": self.operation, "phase": phase, "pid": os.getpid(), "rss_bytes": peak, "peak_rss_bytes": peak, **details}
        self.sequence += 1
        self.last = now
        self.lines.append(line)
        if self.file:
            self.file.write(json.dumps(line) + "\n")
            self.file.flush()

    def maybe(self, phase: str, **details) -> None:
        if time.time() - self.last >= self.interval:
            self.event(phase, **details)

    @contextmanager
    def watching(self, spark: SparkSession, phase: str) -> Iterator[None]:
        """While the body runs, a line an interval with the running stages and their tasks, unless other lines came."""
        done = threading.Event()

        def watch() -> None:
            tracker = spark.sparkContext.statusTracker()
            while not done.wait(self.interval):
                stages = [i for k in tracker.getActiveStageIds() if (i := tracker.getStageInfo(k))]
                self.maybe(phase, stages=len(stages), tasks=sum(i.numTasks for i in stages), tasks_done=sum(i.numCompletedTasks for i in stages), tasks_running=sum(i.numActiveTasks for i in stages))

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def close(self) -> None:
        if self.file:
            self.file.close()
