"""Tab-separated text with named headers.

Headers are free in order, may start with ``#`` and may have columns that nobody asked for; fields are never quoted.
The codec follows from the suffix (plain, ``.gz``, ``.zst``). Only a file's first line is its header, whatever other
rows look like. Rows have their number in the file: Spark numbers rows inside each block of a file, and a count of the
blocks says how many rows come before. Many files are one read, each with its own header. A folder of part files, a header
in each, is read like one file.
"""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.operators.checks import InputError, checked, require_empty


#: Blocks up to which their row numbers are part of the expression: each row compares paths with all of them until one fits.
FEW_BLOCKS = 4


def _plain(path: str) -> str:
    """A path without scheme and authority, as file metadata may spell it."""
    return posixpath.normpath(unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)))


def numbered_lines(spark: SparkSession, paths: list[str], skip_meta: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """(file, number, before, line) and the first lines: lines that are not blank (nor start with ``##``), numbered from 0 in each file.

    ``before`` is the number of data rows in the files that come before in the same folder, if a path is a folder of parts. One job
    counts the lines of each block of a file (a row a block on the driver); all later reads are narrow.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.where(F.col("line") != "")
    if skip_meta:
        lines = lines.where(~F.col("line").startswith("##"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min(F.struct("at", "line")).alias("first"), F.count("*").alias("n")).collect()
    inside, shifts, first = {}, [], {}
    for b in sorted(blocks, key=lambda b: (b["file"], b["block"])):
        first.setdefault(b["file"], b["first"]["line"])
        shifts.append((b["file"], b["block"], inside.get(b["file"], 0) - b["first"]["at"]))
        inside[b["file"]] = inside.get(b["file"], 0) + b["n"]
    given, before, start = {_plain(p) for p in paths}, {}, {}
    for file in sorted(inside):
        owner = owner_of(file, given)
        start[file] = before.get(owner, 0)
        before[owner] = start[file] + inside[file] - 1
    rows = [(f, b, n, start[f]) for f, b, n in shifts]
    if len(rows) <= FEW_BLOCKS:
        # Spelled out in the projection; a join only where that would be long.
        pick = lambda k: F.coalesce(*(F.when((F.col("file") == r[0]) & (F.col("block") == r[1]), F.lit(r[k])) for r in rows), F.lit(0)).cast("long")
        return lines.select("file", (F.col("at") + pick(2)).alias("number"), pick(3).alias("before"), "line"), first
    table = spark.createDataFrame(rows, "file string, block long, shift long, before long")
    return lines.join(F.broadcast(table), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("number"), "before", "line"), first


def owner_of(file: str, given: set[str]) -> str:
    """The given path that a file is, or lies in."""
    plain = _plain(file)
    return plain if plain in given else posixpath.dirname(plain)


def _names(line: str, path: str) -> list[str]:
    names = [n.removeprefix("#") for n in line.split("\t")]
    if len(set(names)) < len(names):
        raise InputError(f"{path} has a column twice")
    return names


def header_of(spark: SparkSession, path: str, skip_meta: bool = False) -> list[str]:
    lines = spark.read.text(path)
    if skip_meta:
        lines = lines.where(~F.col("value").startswith("##") & (F.length(F.rtrim("value")) > 0))
    first = lines.first()
    if first is None:
        raise InputError(f"{path} is empty")
    return _names(first["value"].rstrip("\r"), path)


def read_tables(spark: SparkSession, paths: list[str], required: list[str], optional: list[str] = (), *, numbered: str | None = None, skip_meta: bool = False, upper_header: bool = False, file: str | None = None, fused: bool = False) -> DataFrame:
    """Required columns, and those optional ones that all files have, as strings, of all files in one read.

    ``numbered`` adds the row number in the file, which counts all data rows before any filter; ``file`` the path as given.
    Short rows are an error at once, or if ``fused``, when a job reads the row.
    """
    given = {_plain(p): p for p in paths}
    lines, first = numbered_lines(spark, paths, skip_meta)
    heads: dict[str, list[tuple[str, str]]] = {}
    for part, line in first.items():
        heads.setdefault(owner_of(part, set(given)), []).append((part, line))
    places = []
    wanted = [*required, *optional]
    for plain, path in given.items():
        if plain not in heads:
            raise InputError(f"{path} is empty")
        for part, line in heads[plain]:
            names = _names(line, path)
            if upper_header:
                names = _names("\t".join(n.upper() if n.isascii() else n for n in names), path)
            for name in required:
                if name not in names:
                    raise InputError(f"{path} lacks column {name}")
            places.append((part, path, [names.index(c) if c in names else -1 for c in wanted]))
    wanted = [c for k, c in enumerate(wanted) if all(x[2][k] >= 0 for x in places)]
    kept = [(f, path, [at[[*required, *optional].index(c)] for c in wanted]) for f, path, at in places]
    parsed = lines.where("number > 0").withColumn("f", F.split("line", "\t", -1))
    if len(kept) == 1:
        at = [F.lit(k) for k in kept[0][2]]
        parsed = parsed.withColumn("path", F.lit(kept[0][1]))
    else:
        parsed = parsed.join(F.broadcast(spark.createDataFrame(kept, "file string, path string, at array<int>")), "file")
        at = [F.col("at")[k] for k in range(len(wanted))]
    short = F.size("f") <= F.greatest(*at, F.lit(0), F.lit(0))
    if fused:
        parsed = parsed.withColumn("f", checked(F.col("f"), short, "short row", F.col("path"), F.col("line")))
    else:
        require_empty(parsed.where(short).select("path", "line"), "short row")
    extra = ([F.col("path").alias(file)] if file else []) + ([(F.col("before") + F.col("number") - 1).alias(numbered)] if numbered else [])
    return parsed.select(*extra, *(F.get(F.col("f"), k).alias(c) for k, c in zip(at, wanted, strict=True)))


def read_table(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), **options) -> DataFrame:
    """The same for one file."""
    return read_tables(spark, [path], required, optional, **options)


def resolve(base: str, path: str) -> str:
    """``path``, or if relative, beside the file ``base``."""
    return path if re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)?/", path) else posixpath.normpath(posixpath.join(posixpath.dirname(base), path))


def read_list(spark: SparkSession, path: str, columns: list[str], what: str) -> list[dict[str, str]]:
    """A short list of files, on the driver: each of ``columns`` may name alternatives as ``A|B``. Paths are resolved beside the list."""
    names = header_of(spark, path)
    picked = []
    for c in columns:
        found = [x for x in c.split("|") if x in names]
        if not found:
            raise InputError(f"{path} lacks column {c}")
        picked.append((c.split("|")[0], found[0]))
    rows = read_table(spark, path, [c for _, c in picked]).collect()
    out = [{key: resolve(path, r[c]) for key, c in picked} for r in rows]
    if any(not r[c] for r in rows for _, c in picked):
        raise InputError(f"{path} has a blank path")
    if not out:
        raise InputError(f"{path} lists no {what}")
    first = picked[0][0]
    if len({r[first] for r in out}) < len(out):
        raise InputError(f"{path} lists a {what} twice")
    return out
