"""Toxicity as cumulative-link ordinal regression on sparse text features.

Grades are the label column's own ordered values, 0 upwards (the given labels have two: 0 and 1). One weight vector w
is shared by all thresholds, P(grade <= k) = sigmoid(t_k - w.x); the output is the expected grade. Features are words
and word prefixes (3 to 7 letters), so that inflected forms share evidence. All of them are hashed into ``SPACE``
places as log(1 + count) times the place's evidence in the sample (by how many standard errors over ``SURE`` its
log-odds ratio differs from zero) and scaled to length one, so that a chance hit in a long text weighs little.

Fitting uses a bounded sample of labelled rows: ``SAMPLE`` with grade 0 and as many above, in expectation, taken by a
hash of the identifier. Their sparse features (a row has at most ``SPACE`` entries) come to the driver, where numpy runs stochastic gradient descent. A
fifth of the sample, by the same hash, is held out to choose the threshold of rejection (best F1). Prediction reads all
rows whole; the model that travels with the tasks has ``SPACE`` weights, whatever the input.

Defined cases: a null or wordless text has no features and is never rejected. Labels that are null, or of unknown
documents or null identifiers, are ignored; a document labelled twice counts with its highest label. Without any label
of 0 or any above nothing is rejected. Repeated rows are judged row by row, empty tables give empty results, and other
columns pass through ``keep_clean`` untouched.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import broadcast_if_small, checkpointed, forget, kept, list_rows, table, text_parts

SAMPLE, SPACE, HELD_OUT, SURE = 4000, 1 << 18, 5, 2.0
PREFIXES = range(3, 8)
_WORD = regex.compile(r"\p{L}+")
#: Words whose places are remembered by a worker, and words of a text whose features are counted at once.
_CACHE, _CHUNK = 1 << 17, 1 << 18


class Model(NamedTuple):
    evidence: np.ndarray  # by place
    weights: np.ndarray  # by place
    thresholds: np.ndarray
    reject: float


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Places(dict):
    """The places of a word's features, remembered as the bytes of 32-bit numbers."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        found = self[word] = array("i", [xxhash.xxh64_intdigest(f) % SPACE for f in features_of(word)]).tobytes()
        return found


def sparse(text: str | None, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Places in order and values of a text: log(1 + count)."""
    ws = _WORD.findall((text or "").lower())
    k, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(ws), _CHUNK):
        more, n = np.unique(np.frombuffer(b"".join(map(places.__getitem__, ws[at : at + _CHUNK])), np.int32), return_counts=True)
        if at:
            more, back = np.unique(np.concatenate([k, more]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c, n])).astype(np.int64)
        k, c = more.astype(np.int64), n
    return k, np.log1p(c)


def weighed(k: np.ndarray, v: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    x = v * evidence[k]
    return x / np.sqrt((x * x).sum() or 1.0)


class Weighed(Sequence):
    """Rows with their values weighed when they are asked for, so that no second copy of them is held."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], evidence: np.ndarray) -> None:
        self.rows, self.evidence = rows, evidence

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k, v = self.rows[i]
        return k, weighed(k, v, self.evidence)


def evidence_of(rows: list[tuple[np.ndarray, np.ndarray]], above: np.ndarray) -> np.ndarray:
    """Of each place, from how many rows above grade 0 and how many of grade 0 have it."""
    a, b = np.ones(SPACE), np.ones(SPACE)
    for (k, _), y in zip(rows, above, strict=True):
        (a if y else b)[k] += 1
    odds = np.log(a / (above.sum() + 2)) - np.log(b / ((~above).sum() + 2))
    return np.maximum(np.abs(odds) / np.sqrt(1 / a + 1 / b) - SURE, 0)


def severity(model: Model, z: np.ndarray) -> np.ndarray:
    """Expected grade of rows with the linear predictors z."""
    return (1 / (1 + np.exp(np.clip(model.thresholds[None, :] - z[:, None], -500, 500)))).sum(axis=1)


def fit_ordinal(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by stochastic gradient descent (steps scaled by each place's own gradients) on the cumulative-link likelihood."""
    cuts, rng = int(y.max()), np.random.default_rng(seed)
    w, seen = np.zeros(size), np.full(size, 1e-8)
    # The thresholds are the first one and the logs of the gaps; they start at the grades' shares.
    t = np.array([np.log(((y <= k).sum() + 0.5) / ((y > k).sum() + 0.5)) for k in range(cuts)])
    p = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 0.1))])
    p_seen = np.full(cuts, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            gaps = np.exp(p[1:])
            t = p[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            z = v @ w[k]
            below = sigmoid(t[y[i] - 1] - z) if y[i] else 0.0
            upto = sigmoid(t[y[i]] - z) if y[i] < cuts else 1.0
            lik, slope_b, slope_u = max(upto - below, 1e-9), below * (1 - below), upto * (1 - upto)
            dz = (slope_u - slope_b) / lik  # of -log(likelihood) by z
            g = dz * v + decay * w[k]
            seen[k] += g * g
            w[k] -= step * g / np.sqrt(seen[k])
            dt = np.zeros(cuts)
            if y[i] < cuts:
                dt[y[i]] -= slope_u / lik
            if y[i]:
                dt[y[i] - 1] += slope_b / lik
            dp = np.concatenate([[dt.sum()], [dt[j + 1 :].sum() * gaps[j] for j in range(cuts - 1)]])
            p_seen += dp * dp
            p -= step * dp / np.sqrt(p_seen)
    return w, p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The model, or None if there is no label of 0 or none above."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    total = {r[0]: r[1] for r in marked.groupBy((F.col("y") > 0).cast("int")).count().collect()}
    if not total.get(0) or not total.get(1):
        return None
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000))
    share = F.when(F.col("y") > 0, F.lit(1e6 * sample / total[1])).otherwise(F.lit(1e6 * sample / total[0]))
    chosen = checkpointed(marked.where(draw < share).select("id", "y", F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(HELD_OUT)).alias("fold")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = kept("toxicity", Places)
        for b in text_parts(batches, 3):
            found = [sparse(text, places) for text in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1), b.column(2), pa.array([k.astype(np.int32) for k, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                names=["id", "y", "fold", "k", "v"],
            )

    # ``chosen`` has twice ``sample`` rows in expectation; documents that share an identifier are taken with one of their rows.
    rows = texts.join(broadcast_if_small(chosen, 8 * sample), "id").groupBy("id", "y", "fold").agg(F.min("text").alias("text"))
    data = rows.mapInArrow(of_batches, "id string, y int, fold long, k array<int>, v array<float>")
    # The sample is bounded, so one task fits it: the driver gets the model only, not the features.
    found = data.repartition(1).mapInArrow(_fitting, "evidence binary, weights binary, thresholds binary, reject double").collect()
    if not found:
        return None
    return Model(np.frombuffer(found[0]["evidence"], np.float32), np.frombuffer(found[0]["weights"], np.float32), np.frombuffer(found[0]["thresholds"], np.float64), found[0]["reject"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample as one row, none if it holds one side only."""
    forget()
    held = list(batches)
    model = fitted_model(pa.Table.from_batches(held)) if held else None
    if model is not None:
        yield pa.RecordBatch.from_pylist([{"evidence": model.evidence.tobytes(), "weights": model.weights.tobytes(), "thresholds": model.thresholds.astype(np.float64).tobytes(), "reject": model.reject}])


def fitted_model(data: pa.Table) -> Model | None:
    """The model of (id, y, fold, k, v), in order of ``id``."""
    # Rows are put in order as views: the features themselves are not copied.
    order = pc.sort_indices(data["id"])
    grades = data["y"].take(order).to_numpy()
    y = np.unique(grades, return_inverse=True)[1]
    if not len(y) or grades.min() > 0 or not y.max():
        return None
    unordered = list(zip(list_rows(data["k"]), list_rows(data["v"]), strict=True))
    fitted = [unordered[i] for i in order.to_pylist()]
    held = data["fold"].take(order).to_numpy() == 0
    if not (held & (y > 0)).any() or not (held & (y == 0)).any() or len(np.unique(y[~held])) <= y.max():
        held = np.zeros(len(y), bool)
    known = [r for r, h in zip(fitted, held, strict=True) if not h]
    evidence = evidence_of(known, y[~held] > 0)
    weights, thresholds = fit_ordinal(Weighed(known, evidence), y[~held], SPACE)
    model = Model(evidence.astype(np.float32), weights.astype(np.float32), thresholds, 0.5)
    judged = held if held.any() else ~held
    score = severity(model, np.array([weighed(k, v, evidence) @ weights[k] for (k, v), j in zip(fitted, judged, strict=True) if j]))
    truth = y[judged] > 0
    cuts = np.unique(np.concatenate([score, [0.5]]))
    f1 = np.array([2 * (truth & (score >= c)).sum() / max(1, truth.sum() + (score >= c).sum()) for c in cuts])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    # Halfway between the scores that the best cuts separate.
    low = cuts[best[0] - 1] if best[0] else 0.0
    return model._replace(reject=float((low + cuts[best[-1]]) / 2))


def judged(model: Model, texts: Iterator[str | None], places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Severity and verdict of each text."""
    z, some = [], []
    for text in texts:
        k, v = sparse(text, places)
        z.append(float(weighed(k, v, model.evidence) @ model.weights[k]))
        some.append(len(k) > 0)
    s = severity(model, np.array(z, float))
    return s, (s >= model.reject) & np.array(some, bool)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same, severity, rejected), one row per row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    if model is None:
        return narrow.select("id", "same", F.lit(0.0).alias("severity"), F.lit(False).alias("rejected"))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = kept("toxicity", Places)
        for b in text_parts(batches, 2):
            s, bad = judged(shared.value, b.column(2).to_pylist(), places)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(bad)], names=["id", "same", "severity", "rejected"])

    return narrow.mapInArrow(of_batches, f"id {narrow.schema['id'].dataType.simpleString()}, same long, severity double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all columns: a filter inside the scan's stage."""
    if model is None:
        return docs
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = kept("toxicity", Places)
        for b in text_parts(batches, place):
            yield b.filter(pa.array(~judged(shared.value, b.column(place).to_pylist(), places)[1]))

    return docs.mapInArrow(of_batches, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), F.round("severity", 6).alias("expected_severity"), F.col("rejected").alias("toxic"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
