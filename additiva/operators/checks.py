"""Validation: what must not happen is a DataFrame that must be empty."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """The input breaks a rule of the data model."""


def require_empty(df: DataFrame, message: str) -> None:
    """Raises if ``df`` has a row; names the first one found. Reads one row at most."""
    row = df.limit(1).collect()
    if row:
        raise InputError(f"{message}: {', '.join(f'{k}={v!r}' for k, v in row[0].asDict().items())}")


def require(df: DataFrame, rule: Column, message: str, show: Iterable[str] = ()) -> DataFrame:
    """``df`` unchanged; raises if a row breaks ``rule`` (null counts as broken)."""
    bad = df.where(~F.coalesce(rule, F.lit(False)))
    require_empty(bad.select(*show) if show else bad, message)
    return df


def checked(value: Column, bad: Column, message: str, *shown: Column) -> Column:
    """``value``, or an error where ``bad`` holds: a rule inside the scan that uses the value, without a job of its own."""
    text = F.concat_ws(", ", F.lit(f"{BROKEN}{message}:"), *(s.cast("string") for s in shown))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text)).otherwise(value)


#: Marks errors of ``checked`` among those of Spark.
BROKEN = "broken rule: "


@contextmanager
def as_input_errors() -> Iterator[None]:
    """Errors of ``checked`` that come up while a job runs, as ``InputError``."""
    try:
        yield
    except PySparkException as e:
        found = re.search(f"{BROKEN}([^\\n]*)", str(e))
        if not found:
            raise
        raise InputError(found[1].split(" SQLSTATE")[0]) from e


def require_unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    require_empty(df.groupBy(*keys).count().where("count > 1").select(*keys), message)
    return df


def require_same(left: DataFrame, right: DataFrame, key: str, columns: list[str], message: str) -> None:
    """Both sides have the same rows by position (``key``); nulls equal nulls."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in [key, *columns]))
    same = F.col(f"r_{key}").isNotNull() & F.col(key).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    require_empty(left.select(key, *columns).join(r, F.col(key) == F.col(f"r_{key}"), "full").where(~same), message)


#: Rows of a few columns up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
