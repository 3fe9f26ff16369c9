"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

A text's letter n-grams (1 to 4 letters, words padded by a space, other characters dropped) are hashed into
``BUCKETS`` embeddings; their average goes through a linear softmax. Both layers are trained by stochastic gradient
descent in numpy on the driver, from a bounded sample: ``PER_LANGUAGE`` training rows of each language in expectation
(fewer if there are so many languages that the sample would pass ``SAMPLE`` rows), taken by a hash of the identifier
and kept as sparse rows. A fifth of the sample is held out to fit a temperature for the probabilities and
the least probability at which accepted texts reach ``ACCURACY``; less sure ones are marked ``rejected``.

Prediction uses the whole text and nothing else. The model that travels with the tasks has a fixed size.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a null language is not learned from; a
null identifier belongs to the training rows. Without training rows every text is ``und``. Repeated rows are predicted
row by row; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import list_rows, table

BUCKETS, DIM, PER_LANGUAGE, SAMPLE, FOLDS, ACCURACY = 8192, 16, 500, 20_000, 3, 0.99
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Characters whose n-grams are counted at once.
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


class Model(NamedTuple):
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def is_letter() -> np.ndarray:
    """By code point."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of a text's n-grams; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[codes]
    if not letter.any():
        return None
    kept = np.where(letter, codes, 32)
    kept = kept[letter | np.concatenate([[True], letter[:-1]])]  # one space for each run of others
    x = np.concatenate([[32], kept, [32]]).astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK + 3]
        key = np.zeros(len(part), np.uint64)
        for n in range(4):
            if len(part) <= n:
                break
            key = key[: len(part) - n] * np.uint64(_PRIMES[0]) + part[n:] * np.uint64(_PRIMES[1]) + np.uint64(n + 1)
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(_PRIMES[2])
            out += np.bincount((mixed >> np.uint64(40)).astype(np.int64)[: min(len(mixed), _CHUNK)] % BUCKETS, minlength=BUCKETS)
    return out


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A few sparse rows (places, shares) as a matrix."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for row, (k, v) in zip(x, rows, strict=True):
        row[k] = v
    return x


def averages(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([v @ model.embeddings[k] for k, v in rows])


def _probabilities(model: Model, h: np.ndarray) -> np.ndarray:
    """Of each language, from rows of averaged embeddings."""
    z = (h @ model.weights + model.bias) / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 1, F.lit(False))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 4.0, batch: int = 32, seed: int = 7) -> Model:
    """Stochastic gradient descent on sparse rows of n-gram shares."""
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            x = dense([rows[k] for k in some])
            h = x @ e
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            dh = p @ w.T
            w -= step * (h.T @ p)
            b -= step * p.sum(axis=0)
            e -= step * 20 * (x.T @ dh)
    model = Model(languages, e, w, b, 1.0, 0.0)
    if held.any():
        truth, h = y[held], averages(model, [rows[k] for k in np.flatnonzero(held)])
        models = [model._replace(temperature=float(t)) for t in np.geomspace(0.1, 4, 40)]
        loss = [-np.log(np.maximum(_probabilities(m, h)[np.arange(len(truth)), truth], 1e-9)).mean() for m in models]
        model = models[int(np.argmin(loss))]
        p = _probabilities(model, h)
        sure, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-sure)
        fine = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCURACY)
        model = model._replace(least=float(sure[order][fine[-1]]) if len(fine) else 1.0)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), is_held_out(id_col).alias("held")).where("NOT held AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    per_language = min(per_language, max(1, SAMPLE // len(languages)))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(1e6 * per_language / n)) for lang, n in sizes.items()))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000)) < share)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, lang, c) for i, lang, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(counts, b.column(2).to_pylist()), strict=True) if c is not None]
            places = [np.flatnonzero(c) for _, _, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(i) for i, _, _ in found], pa.string()), pa.array([lang for _, lang, _ in found], pa.string()), pa.array([k.astype(np.int32) for k in places], pa.list_(pa.int32())), pa.array([c[k].astype(np.int32) for (_, _, c), k in zip(found, places, strict=True)], pa.list_(pa.int32()))],
                names=["id", "lang", "k", "c"],
            )

    data = sample.select("id", "lang", "text").mapInArrow(of_batches, "id string, lang string, k array<int>, c array<int>").toArrow().sort_by("id")
    if not data.num_rows:
        return None
    rows = [(k, (c / c.sum()).astype(np.float32)) for k, c in zip(list_rows(data["k"]), list_rows(data["c"]), strict=True)]
    return fit(rows, np.array([languages.index(lang) for lang in data["lang"].to_pylist()]), languages)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), one row per row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    if model is None:
        out = narrow.select("id", "held", F.lit("und"), F.lit(0.0), F.lit(True))
        return out.toDF(id_col, "held_out", "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(2).to_pylist():
                c = counts(text)
                if c is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                k = np.flatnonzero(c)
                average = (c[k].astype(np.float32) / c[k].sum()) @ m.embeddings[k]
                z = (average @ m.weights + m.bias).astype(np.float64) / m.temperature
                z = np.exp(z - z.max())
                langs.append(m.languages[int(z.argmax())])
                scores.append(float(z.max() / z.sum()))
            p = np.array(scores)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(p), pa.array(p < m.least)], names=["id", "held", "lang", "score", "rejected"])

    return narrow.mapInArrow(of_batches, f"id {narrow.schema['id'].dataType.simpleString()}, held boolean, lang string, score double, rejected boolean").toDF(id_col, "held_out", "lang_pred", "score", "rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
