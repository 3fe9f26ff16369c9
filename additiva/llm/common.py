"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.functions.shared import checkpointed, stored  # noqa: F401  used by the operators

#: ASCII white space that separates words everywhere in this subpackage: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null and blank texts give an empty array."""
    pieces = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    return F.filter(pieces, lambda w: w != "")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a variation that clashes with no column of the frames (Spark resolves names without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows up to which a table of a few narrow columns is broadcast; beyond it the join is an ordinary shuffle join.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows. Meant for materialised tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of text that Python tasks take up at once.
PART_BYTES = 1 << 20


def text_parts(batches: Iterable[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in views of about ``most`` bytes of a text column, one row at least: Python's texts and results are of a part, not of a batch."""
    for b in batches:
        # A row counts some bytes itself, so that parts of empty texts are bounded too.
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends = np.flatnonzero(np.diff(np.cumsum(sizes) // (most or PART_BYTES))) + 1
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
            yield b.slice(start, end - start)


_KEPT: dict[Hashable, object] = {}


def kept[T](key: Hashable, build: Callable[[], T]) -> T:
    """``build()``, kept by a Python worker for later tasks with this key. What another key left there goes first: a worker
    outlives its tasks and serves all operators, so it holds the tables of one at a time."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Gives back what a worker kept, also what refers to itself."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column without nulls, as views of its values."""
    rows: list[np.ndarray] = []
    for part in column.chunks:
        values, ends = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
        rows += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return rows
