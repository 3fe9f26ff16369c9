"""Scoring as a blocked product: weights by calls, in blocks of variants x samples x scores.

Both sides are dealt out by (tile of variants, block of samples, block of scores). A task adds up one block with numpy: for each
variant the outer product of its weights and its calls goes into a matrix of at most ``SCORES`` x ``SAMPLES`` numbers, so with few scores
a block has more samples (``span_of``), unless a tile's calls are dense. A variant's weights are one row of arrays and go to those
blocks only in which their tile has calls, so copies of the weights are bounded by the calls and not by tiles times blocks. Only what
was touched is given out, as vectors by (score, ``SAMPLES`` samples), and vectors are added up in two steps (``FAN`` tiles first), so no
task holds all tiles of a score.

The order of sums is fixed: variants of a tile by number and a variant's weights by ``order``, then tiles by number, ``FAN`` of them first.

Compared with the join of single rows (``scoring.evaluate``) the shuffle after the product has one row a (tile, score, block)
instead of one a (score, sample), and products never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from additiva.functions.shared import stored
from additiva.operators.checks import broadcast_if_small
from additiva.operators.scoring import baselines, combined, on_grid, with_common

SAMPLES, SCORES, FAN = 4096, 1024, 64
_VECTOR = pa.schema([("score_idx", pa.int64()), ("block", pa.int64()), ("tile_idx", pa.int64()), ("at", pa.list_(pa.int32())), ("upd", pa.list_(pa.float64()))])
_SCHEMA = "score_idx long, block long, tile_idx long, at array<int>, upd array<double>"


#: Calls of a (tile, block) up to which blocks are made wider than ``SAMPLES``.
CALLS = SAMPLES * SCORES


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_VECTOR)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _VECTOR, strict=True)], schema=_VECTOR)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a column of lists."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False)))


def _product(key: tuple, edges: pa.Table, calls: pa.Table) -> pa.Table:
    tile, block, part = (k.as_py() for k in key)
    if not edges.num_rows or not calls.num_rows:
        return _table([])
    ids = edges["v"].to_numpy()
    by_id = np.argsort(ids)
    ids, mean, common = ids[by_id], edges["mean"].to_numpy()[by_id], edges["common"].to_numpy()[by_id]
    (score, ends), (beta, _) = _lists(edges["scores"]), _lists(edges["betas"])
    score = score - part * SCORES
    at = np.searchsorted(ids, calls["v"].to_numpy())
    known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == calls["v"].to_numpy())
    at, dosage = at[known], calls["dosage"].to_numpy()[known]
    people, sample = np.unique(calls["sample_idx"].to_numpy()[known], return_inverse=True)
    x = np.where(np.isnan(dosage), mean[at], dosage) - common[at]
    c_by = np.argsort(at, kind="stable")
    c_ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(ids))))
    total, touched = np.zeros((int(score.max()) + 1, len(people))), np.zeros((int(score.max()) + 1, len(people)), bool)
    for k in np.flatnonzero(np.diff(c_ends)).tolist():
        e, c = slice(ends[by_id[k]], ends[by_id[k] + 1]), c_by[c_ends[k] : c_ends[k + 1]]
        s, w, who = score[e], beta[e], sample[c]
        if len(np.unique(s)) == len(s):
            # A variant's scores and its samples differ among themselves, so nothing is added twice at one place.
            place = np.ix_(s, who)
            total[place] += w[:, None] * x[c]
            touched[place] = True
        else:
            for one, weight in zip(s.tolist(), w.tolist(), strict=True):
                total[one, who] += weight * x[c]
                touched[one, who] = True
    rows = []
    for k in np.flatnonzero(touched.any(axis=1)).tolist():
        some = np.flatnonzero(touched[k])
        small = people[some] // SAMPLES
        cuts = np.append(0, np.flatnonzero(np.diff(small)) + 1).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(some)], strict=True):
            rows.append((part * SCORES + k, int(small[a]), tile, (people[some[a:b]] - small[a] * SAMPLES).astype(np.int32), total[k, some[a:b]]))
    return _table(rows)


def _added(key: tuple, group: pa.Table) -> pa.Table:
    total, touched = np.zeros(SAMPLES), np.zeros(SAMPLES, bool)
    (at, ends), (upd, _) = _lists(group["at"]), _lists(group["upd"])
    tiles = group["tile_idx"].to_numpy()
    for k in np.argsort(tiles, kind="stable").tolist():
        one = slice(ends[k], ends[k + 1])
        total[at[one]] += upd[one]
        touched[at[one]] = True
    some = np.flatnonzero(touched)
    return _table([(key[0].as_py(), key[1].as_py(), int(tiles[0]) // FAN, some.astype(np.int32), total[some])])


def span_of(n_scores: int, calls_of_tile: int, last_sample: int) -> int:
    """Samples of a block: a block's numbers and, if a tile's calls spread over the samples, its calls stay as many as with ``SAMPLES`` samples and ``SCORES`` scores."""
    by_scores = SCORES // max(1, min(n_scores, SCORES))
    by_calls = CALLS * (last_sample + 1) // max(1, calls_of_tile) // SAMPLES
    return SAMPLES * max(1, min(by_scores, by_calls))


def products(edges: DataFrame, calls: DataFrame, n_scores: int, last_sample: int, tile: Column, key: str = "ordinal", order: str | None = None) -> DataFrame:
    """(score_idx, sample_idx, upd) of edges (score_idx, key, beta, mean, common) with numeric keys, one row a (score, variant), or several
    that are added up by ``order``. ``calls`` are read three times."""
    parts = max(1, -(-n_scores // SCORES))
    e = edges.select(tile.alias("tile_idx"), F.col(key).cast("long").alias("v"), F.col("score_idx").cast("long").alias("score_idx"), F.col("beta").cast("double").alias("beta"), F.col("mean").cast("double").alias("mean"), F.col("common").cast("double").alias("common"), F.col(order or "score_idx").alias("at"))
    e = e.na.fill(float("nan"), ["mean"]).groupBy("tile_idx", "v", F.floor(F.col("score_idx") / SCORES).alias("part")).agg(F.first("mean").alias("mean"), F.first("common").alias("common"), F.array_sort(F.collect_list(F.struct("at", "score_idx", "beta"))).alias("x"))
    e = e.select("tile_idx", "v", "part", "mean", "common", F.col("x.score_idx").alias("scores"), F.col("x.beta").alias("betas"))
    c = calls.select(tile.alias("tile_idx"), F.col(key).cast("long").alias("v"), F.col("sample_idx").cast("long").alias("sample_idx"), F.coalesce(F.col("dosage").cast("double"), F.lit(float("nan"))).alias("dosage"))
    most = c.groupBy("tile_idx").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    span = span_of(n_scores, most, last_sample)
    c = c.withColumn("block", F.floor(F.col("sample_idx") / span))
    # Broadcast only where counted small: a (tile, block) is a row of two numbers.
    e = e.join(broadcast_if_small(c.select("tile_idx", "block").distinct().toDF("tile_idx", "block")), "tile_idx")
    c = c.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    by = ["tile_idx", "block", "part"]
    vectors = e.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(lambda key, left, right: _product(key, left, right), _SCHEMA)
    for level in ([F.floor(F.col("tile_idx") / FAN)], []):
        vectors = vectors.groupBy("score_idx", "block", *level).applyInArrow(_added, _SCHEMA)
    rows = vectors.select("score_idx", "block", F.explode(F.arrays_zip("at", "upd")).alias("x"))
    return rows.select("score_idx", (F.col("block") * SAMPLES + F.col("x.at")).alias("sample_idx"), F.col("x.upd").alias("upd"))


def evaluate_blocked(edges: DataFrame, calls: DataFrame, samples: DataFrame, scores: DataFrame, tile: Column, common: DataFrame | None = None, key: str = "ordinal") -> DataFrame:
    """(score_idx, sample_idx, score), the same as ``scoring.evaluate``. Scores and samples are numbered from 0 on, gaps allowed."""
    base = baselines(edges, scores, common, key)
    last, most = samples.agg(F.max("sample_idx")).first()[0], scores.agg(F.max("score_idx")).first()[0]
    e = with_common(combined(edges, key), common, key)
    updates = products(e, stored(calls.select(key, "sample_idx", "dosage")), (most or 0) + 1, last or 0, tile, key)
    return on_grid(base, scores, samples, updates)
