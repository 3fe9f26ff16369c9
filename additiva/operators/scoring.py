"""Score evaluation.

``score[k, s] = sum of w x(v, s)`` over the weight rows of score k whose effect allele is ALT, and of ``w (2 - x(v, s))``
for REF. The plan is the sparse form: a variant's common dosage goes into one number per score, and only exceptions
meet samples. A variant's weights are one row of arrays, so a call is one row in the join and in the one shuffle after it, which is
by sample; only there it becomes a product a score, added up in place. Every sample gets a row for every score: the scores'
baselines are one more such row of every sample, so that no join of (score, sample) follows.

Genotypes: ``calls`` (variant, sample_idx, dosage), dosage null where missing, one row for each exception, and
``common`` (variant, common), the dosage of all samples without a row, null if they are missing; a variant without a row
there has common 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from additiva.operators.checks import InputError, require_empty

#: Scores up to which their baselines are broadcast to the samples.
MOST_SCORES = 100_000
POLICIES = ("cohort", "error", "omit")
#: Weight rows or calls of one task, where a number of parts is asked for.
PART_ROWS = 500_000
#: Products that a task adds up at a time, and sums that it keeps as a matrix of samples by scores, where the order is fixed.
PRODUCTS, CELLS = 1 << 20, 1 << 22


def parts_of(rows: int) -> int:
    """Parts that keep a task's share of so many rows bounded."""
    return max(1, -(-rows // PART_ROWS))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ``parts`` parts, which adaptive execution does not merge; without a number as the session has it."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def cohort_means(calls: DataFrame, n_samples: int, common: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, cohort_mean): mean over all samples that are not missing, the unlisted ones included; null if all are missing."""
    sums = calls.groupBy(key).agg(F.sum("dosage").alias("s"), F.count("dosage").alias("n"), F.count("*").alias("listed"))
    if common is not None:
        sums = sums.join(common.select(key, "common", F.col("common").isNull().alias("unknown")), key, "full")
    else:
        sums = sums.withColumn("common", F.lit(0.0)).withColumn("unknown", F.lit(False))
    # Unlisted samples have the common dosage; where that is null they are missing.
    rest = F.when(F.coalesce("unknown", F.lit(False)), F.lit(0)).otherwise(F.lit(n_samples) - F.coalesce("listed", F.lit(0)))
    known = F.coalesce("n", F.lit(0)) + rest
    total = F.coalesce("s", F.lit(0.0)) + F.coalesce("common", F.lit(0.0)) * rest
    return sums.select(key, F.try_divide(total, known.cast("double")).alias("cohort_mean"))


def with_means(edges: DataFrame, frequencies: DataFrame | None, means: DataFrame | None, policy: str = "cohort", key: str = "id") -> DataFrame:
    """Edges with the dosage ``mean`` that a missing call gets. ``omit`` drops variants without frequency, intercept and
    all; ``error`` refuses them; ``cohort`` falls back on the cohort's mean."""
    if policy not in POLICIES:
        raise InputError(f"unknown policy {policy}")
    if frequencies is None:
        if policy != "cohort":
            raise InputError(f"policy {policy} needs frequencies")
        return edges.join(means.select(key, F.col("cohort_mean").alias("mean")), key, "left")
    known = frequencies.select(key, "alt_dosage_mean")
    if policy == "omit":
        return edges.join(known.withColumnRenamed("alt_dosage_mean", "mean"), key)
    if policy == "error":
        require_empty(edges.select(key).distinct().join(known, key, "left_anti"), "no frequency row for scored variant")
        return edges.join(known.withColumnRenamed("alt_dosage_mean", "mean"), key)
    both = edges.join(known, key, "left").join(means, key, "left")
    return both.withColumn("mean", F.coalesce("alt_dosage_mean", "cohort_mean")).drop("alt_dosage_mean", "cohort_mean")


def combined(edges: DataFrame, key: str = "id") -> DataFrame:
    """One row for each (score, variant): repeated weight rows add up before they meet genotypes."""
    extra = [F.first(c).alias(c) for c in edges.columns if c not in ("score_idx", key, "beta", "intercept")]
    return edges.groupBy("score_idx", key).agg(F.sum("beta").alias("beta"), F.sum("intercept").alias("intercept"), *extra)


def with_common(edges: DataFrame, common: DataFrame | None, key: str = "id") -> DataFrame:
    """Adds the dosage of unlisted samples: 0 for a variant without a row in ``common``, its mean where the row has null."""
    if common is None:
        return edges.withColumn("common", F.lit(0.0))
    known = common.select(key, "common", F.lit(True).alias("_common"))
    return edges.join(known, key, "left").withColumn("common", F.when(F.col("_common"), F.coalesce("common", "mean")).otherwise(F.lit(0.0))).drop("_common")


def baselines(edges: DataFrame, scores: DataFrame, common: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(score_idx, base) of all scores. Needs no grouping by variant: sums by score are combined map-side right after the edges are made."""
    base = with_common(edges, common, key).groupBy("score_idx").agg(F.sum(F.col("intercept") + F.col("beta") * F.col("common")).alias("base"))
    return scores.select("score_idx").join(base, "score_idx", "left").select("score_idx", F.coalesce("base", F.lit(0.0)).alias("base"))


def on_grid(base: DataFrame, scores: DataFrame, samples: DataFrame, updates: DataFrame) -> DataFrame:
    """Every score meets every sample: that is the result's size. The side of scores is broadcast if counted small."""
    few = scores.limit(MOST_SCORES + 1).count() <= MOST_SCORES
    grid = samples.select("sample_idx").crossJoin(F.broadcast(base) if few else base)
    return grid.join(updates, ["score_idx", "sample_idx"], "left").select("score_idx", "sample_idx", (F.col("base") + F.coalesce("upd", F.lit(0.0))).alias("score"))


def packed_edges(edges: DataFrame, key: str = "id", common: DataFrame | None = None) -> DataFrame:
    """(key, mean, common, scores, betas): a row a variant."""
    e = with_common(edges, common, key).groupBy(key).agg(F.first("mean").alias("mean"), F.first("common").alias("common"), F.collect_list(F.struct("score_idx", "beta")).alias("_w"))
    return e.select(key, "mean", "common", F.col("_w.score_idx").alias("scores"), F.col("_w.beta").alias("betas"))


def _met(packed: DataFrame, calls: DataFrame, key: str, parts: int | None) -> DataFrame:
    """(sample_idx, x, scores, betas): a row a call of a variant of ``packed_edges``."""
    calls = dealt(calls, parts, key) if parts else calls
    x = F.coalesce("dosage", "mean") - F.col("common")
    return calls.select(key, "sample_idx", "dosage").join(packed, key).select("sample_idx", x.alias("x"), "scores", "betas")


def _packed(edges: DataFrame, calls: DataFrame, key: str, common: DataFrame | None, parts: int | None = None) -> DataFrame:
    """(sample_idx, x, scores, betas): a row a call of a scored variant."""
    return _met(packed_edges(edges, key, common), calls, key, parts)


def _products(packed: DataFrame, parts: int | None, *kept: str) -> DataFrame:
    """A row a score of rows with ``scores`` and ``betas``, in the partition of its sample."""
    rows = dealt(packed, parts, "sample_idx").select("sample_idx", *kept, F.explode(F.arrays_zip("scores", "betas")).alias("_w"))
    return rows.select("sample_idx", *kept, F.col("_w.scores").alias("score_idx"), F.col("_w.betas").alias("beta"))


def packed_updates(packed: DataFrame, calls: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """(score_idx, sample_idx, upd) of ``packed_edges``, in the partition of their sample."""
    rows = _products(_met(packed, calls, key, parts), parts, "x")
    return rows.groupBy("sample_idx", "score_idx").agg(F.sum(F.col("beta") * F.col("x")).alias("upd")).select("score_idx", "sample_idx", "upd")


def updates(edges: DataFrame, calls: DataFrame, key: str = "id", common: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(score_idx, sample_idx, upd) of edges with one row a (score, variant)."""
    return packed_updates(packed_edges(edges, key, common), calls, key, parts)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(score_idx, sample_idx, upd) of rows (sample_idx, x, scores, betas) sorted by sample: products are added one by one, as they come.
    The sums of the last sample wait, as it may go on."""
    names = ["score_idx", "sample_idx", "upd"]
    person, held, sums = -1, np.zeros(0, np.int64), np.zeros(0)
    for b in batches:
        sample, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        scores, betas = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
        ends = np.append(0, np.cumsum(b.column(2).value_lengths().to_numpy()))
        first = 0
        while first < len(sample):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PRODUCTS, "right")) - 1)
            if sample[first] != person:
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), person)), pa.array(sums)], names=names)
                person, held, sums = sample[first], held[:0], sums[:0]
            at = np.cumsum(np.diff(sample[first:last], prepend=person) != 0)
            row, some = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), slice(ends[first], ends[last])
            score = np.append(held, scores[some])
            width = int(score.max(initial=0)) + 1
            place = np.append(np.zeros(len(held), np.int64), at[row]) * width + score
            found = None
            if (at[-1] + 1) * width > CELLS:
                found, place = np.unique(place, return_inverse=True)
            # Adds up from the first to the last.
            total = np.bincount(place, np.append(sums, betas[some] * x[first:last][row]))
            if found is None:
                found = np.flatnonzero(np.bincount(place))
                total = total[found]
            who, score, done = found // width, found % width, int(np.searchsorted(found, at[-1] * width))
            people = sample[first:last][np.searchsorted(at, who[:done])]
            yield pa.RecordBatch.from_arrays([pa.array(score[:done]), pa.array(people), pa.array(total[:done])], names=names)
            person, held, sums, first = sample[last - 1], score[done:], total[done:], last
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), person)), pa.array(sums)], names=names)


def ordered_updates(edges: DataFrame, calls: DataFrame, at: str, order: str, key: str = "id", parts: int | None = None) -> DataFrame:
    """(score_idx, sample_idx, upd) of edges (score_idx, key, beta, mean, ``order``) with any number of rows a (score, variant), the same bits
    on each run: a sample's calls are added up by ``at``, the number of their variant, and a variant's weights by ``order``.

    A call meets its variant's weights as one row of arrays and goes once to the part of its sample; weights are not copied to blocks of
    samples, so work follows calls times weights of a variant and not the number of samples. Without dosage and mean a call adds nothing.
    """
    e = dealt(edges.where("beta IS NOT NULL"), parts, key).groupBy(key).agg(F.first("mean").alias("mean"), F.sort_array(F.collect_list(F.struct(order, F.col("score_idx").cast("int").alias("score_idx"), F.col("beta").cast("double").alias("beta")))).alias("_w"))
    e = e.select(key, "mean", F.col("_w.score_idx").alias("scores"), F.col("_w.beta").alias("betas"))
    calls = dealt(calls.select(key, at, F.col("sample_idx").cast("long").alias("sample_idx"), "dosage"), parts, key) if parts else calls
    met = calls.join(e, key).select("sample_idx", at, F.coalesce("dosage", "mean").cast("double").alias("x"), "scores", "betas").where("x IS NOT NULL")
    rows = dealt(met, parts, "sample_idx").sortWithinPartitions("sample_idx", at).select("sample_idx", "x", "scores", "betas")
    return rows.mapInArrow(_in_order, "score_idx long, sample_idx long, upd double")


def total(base: DataFrame, scores: DataFrame, samples: DataFrame, edges: DataFrame, calls: DataFrame, key: str = "id", common: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(score_idx, sample_idx, score): ``base`` plus ``updates`` on the grid of all scores and samples."""
    if scores.limit(MOST_SCORES + 1).count() > MOST_SCORES:
        return on_grid(base, scores, samples, updates(edges, calls, key, common, parts))
    one = base.agg(F.collect_list(F.struct("score_idx", "base")).alias("_w")).select(F.col("_w.score_idx").alias("scores"), F.col("_w.base").alias("betas"))
    grid = samples.select("sample_idx").crossJoin(F.broadcast(one)).select("sample_idx", F.lit(None).cast("double").alias("x"), "scores", "betas", F.lit(True).alias("known"))
    # An update whose mean is null is null too and left out of the sum: only ``known`` tells baselines apart.
    rows = _products(_packed(edges, calls, key, common, parts).withColumn("known", F.lit(False)).unionByName(grid), parts, "x", "known")
    sums = rows.groupBy("sample_idx", "score_idx").agg(F.sum(F.col("beta") * F.col("x")).alias("upd"), F.max(F.when(F.col("known"), F.col("beta"))).alias("base"))
    return sums.where("base IS NOT NULL").select("score_idx", "sample_idx", (F.col("base") + F.coalesce("upd", F.lit(0.0))).alias("score"))


def evaluate(edges: DataFrame, calls: DataFrame, samples: DataFrame, scores: DataFrame, common: DataFrame | None = None, key: str = "id", parts: int | None = None) -> DataFrame:
    """(score_idx, sample_idx, score). ``edges`` are (score_idx, key, beta, intercept, mean). ``blocked`` has the form for many calls a variant.

    With ``parts`` (``parts_of``), weights meet by variant in so many parts before they add up, and calls and samples likewise: the
    rows of a task stay the same as the input grows. Calls that lie so already are not shuffled again.
    """
    met = dealt(edges, parts, key) if parts else edges
    return total(baselines(edges, scores, common, key), scores, samples, combined(met, key), calls, key, common, parts)


def require_means(edges: DataFrame, calls: DataFrame, key: str = "id") -> None:
    """All calls missing and no frequency: there is nothing to impute with."""
    missing = calls.where("dosage IS NULL").select(key).distinct()
    require_empty(edges.where("mean IS NULL").select(key).distinct().join(missing, key, "left_semi"), "all samples missing and no frequency")


def arrays(scores: DataFrame, order: list[int], samples: DataFrame) -> DataFrame:
    """The columns of ``samples`` and ``scores``, an array of its scores in the order given: a plan of the same size for any number of scores."""
    places = scores.sparkSession.createDataFrame(list(enumerate(order)), "_place int, score_idx long")
    rows = scores.join(F.broadcast(places), "score_idx").groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("_place", "score"))).alias("_rows"))
    return samples.join(rows.select("sample_idx", F.col("_rows.score").alias("scores")), "sample_idx", "left")


def wide(scores: DataFrame, names: list[tuple[int, str]], samples: DataFrame) -> DataFrame:
    """One row a sample in the order of the cohort, one column a score in the order given."""
    rows = arrays(scores, [k for k, _ in names], samples)
    return rows.select(*samples.columns, *(F.get("scores", k).alias(name) for k, (_, name) in enumerate(names)))
