"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed n-gram model (``ORDER`` words) over lower-cased words with an end token. States are contexts that
occur in training; an arc carries the log-probability of a word that followed the context there, and leads to the
longest context that ends in it; what a state has no arc for follows its failure arc, which carries the backoff weight,
to the next shorter context. The root has an arc for every word of the vocabulary and one for all others.

Smoothing is interpolated with a prior of ``PRIOR`` words: p(w | u) = (c(u w) + PRIOR p(w | u')) / (c(u) + PRIOR), u'
being u without its first word, and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). So the failure arc of u weighs
PRIOR / (c(u) + PRIOR), and all probabilities of a state sum to one.

All n-grams of all training rows are counted and can be used: there is no threshold, list or cap, and nothing of the
model is collected or broadcast. Rows are cut into chunks of some ``CHUNK`` characters, in the partitions they lie in, and
stored as word lists and places in them. A chunk lists its distinct words and n-grams with their counts in its training rows, packed by hash bucket; a bucket's
task adds the counts up over all chunks and answers each chunk; a chunk's task builds the automaton of the n-grams that
occur in it, with counts of the whole corpus, and traverses each text once from left to right. A frequent n-gram is one
entry a chunk, so no key is hot; buckets are dealt by hash and their number grows with the text. A task holds one chunk
(or one text longer than that) or one bucket, so memory is bounded. Words are counted as strings, n-grams by
48 bits of their hash inside a bucket that other bits choose (some two million n-grams share a bucket).

Order 2 is used: order 3 works too, but would move another 1.5 times the input through shuffle and checkpoint.

Defined cases: a null text is empty and scores its end token. A null identifier belongs to the training rows. Without
training rows every token is unknown, with probability one. Repeated rows are dealt and scored one by one. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import LOWER, UPPER, checkpointed, table

ORDER, PRIOR, FOLDS = 2, 30.0, 5
#: Characters of a chunk, characters of text for each bucket, and the least number of buckets.
CHUNK, BUCKET, LEAST_BUCKETS = 4_000_000, 16_000_000, 32
END = b""  # no word is empty
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 1, F.lit(False))


def _joined(context: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Hash of n-grams from those of their contexts and last words."""
    x = (context + np.uint64(n)) * _MIX + word
    x ^= x >> np.uint64(29)
    x *= _STEP
    return x ^ (x >> np.uint64(32))


def compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def decompress(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def deltas(keys: np.ndarray) -> bytes:
    """Rising keys of 48 bits: differences, byte by byte, compressed."""
    return compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def rising(data: bytes) -> np.ndarray:
    planes = np.frombuffer(decompress(data), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


@contextmanager
def uncollected():
    """Without searches for garbage in cycles, of which there is none, while many small objects are made."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Places(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def tokenised(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (END first), the texts as places in that list with an END before and after each, and their sizes."""
    places = Places({END: 0})
    parts = [np.array([0, *map(places.__getitem__, split(t)), 0], np.int32) for t in texts]
    return list(places), np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


class Chunk:
    """The distinct n-grams of tokenised texts, by order, with counts in the training rows."""

    def __init__(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray, training: np.ndarray, order: int) -> None:
        self.words, self.flat, self.sizes = words, flat, sizes
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        trained = np.repeat(training.astype(bool), sizes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.keys = {1: hashes}
        self.counts = {1: np.bincount(flat[trained & (at > 0)], minlength=len(words))}
        self.context: dict[int, np.ndarray] = {}  # place of each n-gram's context among those of the order below
        self.suffix: dict[int, np.ndarray] = {}  # and of the n-gram without its first word
        index, key = flat, hashes[flat]
        for n in range(2, order + 1):
            usable = np.flatnonzero(at >= n - 1)
            key = _joined(np.roll(key, 1), hashes[flat], n)
            self.keys[n], first, back = np.unique(key[usable], return_index=True, return_inverse=True)
            self.counts[n] = np.bincount(back[trained[usable]], minlength=len(self.keys[n]))
            self.context[n], self.suffix[n] = index[usable[first] - 1], index[usable[first]]
            index = np.full(len(flat), -1)
            index[usable] = back

    def texts(self) -> Iterator[list[int]]:
        """Places of the words of each text and of its END."""
        flat, at = self.flat.tolist(), 0
        for n in self.sizes.tolist():
            yield flat[at + 1 : at + n]
            at += n

    def dealt(self, n: int, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Places of the n-grams by bucket, all in a row and (bucket, places) of those buckets that have some."""
        bucket = ((self.keys[n] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        kinds, at = np.unique(bucket[by], return_index=True)
        return by, list(zip(kinds.tolist(), np.split(by, at[1:]), strict=True)) if len(by) else []

    def packed(self, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(order, bucket, entries, counts): words as strings, n-grams as rising hashes."""
        for n, keys in self.keys.items():
            for k, rows in self.dealt(n, buckets)[1]:
                yield n, k, compress(b" ".join([self.words[i] for i in rows.tolist()])) if n == 1 else deltas(keys[rows] >> np.uint64(16)), compress(self.counts[n][rows].astype(np.int64).tobytes())

    def total(self, n: int, answers: dict[tuple[int, int], bytes], buckets: int) -> np.ndarray:
        """Counts of the whole corpus, from the answers of the buckets."""
        by, parts = self.dealt(n, buckets)
        out = np.zeros(len(by), np.int64)
        if parts:
            out[by] = np.concatenate([np.frombuffer(decompress(answers[n, k]), np.int64) for k, _ in parts])
        return out


class Automaton:
    """States and arcs of the n-grams of a chunk, by their counts in the whole corpus."""

    def __init__(self, chunk: Chunk, counts: dict[int, np.ndarray], tokens: int, distinct: int) -> None:
        order = max(counts)
        self.base = (counts[1] + 0.5) / (tokens + 0.5 * (distinct + 1))
        p = {1: self.base}
        # State 0 is the root; contexts that occur in training follow, by order.
        state, states = {}, 1
        for n in range(1, order):
            seen = counts[n] > 0
            state[n] = np.where(seen, states - 1 + np.cumsum(seen), 0)
            states += int(seen.sum())
        self.size = len(counts[1])
        self.failure: list[tuple[float, int]] = [(0.0, 0)] * states
        onto = state.get(1, np.zeros(self.size, np.int64))
        # Arcs by state * size + word: (weight, next state).
        self.arcs: dict[int, tuple[float, int]] = dict(enumerate(zip(np.log10(self.base).tolist(), onto.tolist(), strict=True)))
        for n in range(1, order):
            below = state[n - 1][chunk.suffix[n]] if n > 1 else np.zeros(self.size, np.int64)
            seen = counts[n] > 0
            for s, w, f in zip(state[n][seen].tolist(), np.log10(PRIOR / (counts[n][seen] + PRIOR)).tolist(), below[seen].tolist(), strict=True):
                self.failure[s] = (w, f)
        last = np.arange(self.size)
        for n in range(2, order + 1):
            context, suffix = chunk.context[n], chunk.suffix[n]
            last = last[suffix]
            p[n] = (counts[n] + PRIOR * p[n - 1][suffix]) / (counts[n - 1][context] + PRIOR)
            seen = counts[n] > 0
            onto = state[n] if n < order else state[n - 1][suffix]
            self.arcs.update(zip((state[n - 1][context][seen] * self.size + last[seen]).tolist(), zip(np.log10(p[n][seen]).tolist(), onto[seen].tolist(), strict=True), strict=True))
        self.start = int(state[1][0]) if order > 1 else 0

    def score(self, text: list[int]) -> float:
        """Log-probability of a text (its END included), from left to right."""
        state, total, arc, failure, size = self.start, 0.0, self.arcs.get, self.failure, self.size
        for w in text:
            hit = arc(state * size + w)
            while hit is None:
                weight, state = failure[state]
                total += weight
                hit = arc(state * size + w)
            weight, state = hit
            total += weight
        return total


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, chars, ids, held, sizes, flat, words): rows cut into chunks where they lie, tokenised."""
    narrow = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, ids, held, texts = TaskContext.get().partitionId() << 32, 0, [], [], []

        def out():
            words, flat, sizes = tokenised(texts)
            kept = pa.concat_arrays(ids)
            columns = [pa.array([chunk]), pa.array([size]), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())), pa.array([compress(flat.tobytes())], pa.binary()), pa.array([compress(b" ".join(words))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "chars", "ids", "held", "sizes", "flat", "words"])

        for b in batches:
            for k, (h, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if size and size + len(text or "") > CHUNK:
                    yield out()
                    chunk, size, ids, held, texts = chunk + 1, 0, [], [], []
                ids.append(b.column(0).slice(k, 1))
                held.append(h)
                texts.append(text)
                size += len(text or "") + 1
        if texts:
            yield out()

    return narrow.mapInArrow(of_batches, f"chunk long, chars long, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, flat binary, words binary")


def chunk_of(row: dict, order: int) -> Chunk:
    return Chunk(decompress(row["words"]).split(b" "), np.frombuffer(decompress(row["flat"]), np.int32).astype(np.int64), np.array(row["sizes"]), ~np.array(row["held"], bool), order)


def answered(chunks: DataFrame, buckets: int, order: int) -> DataFrame:
    """(chunk, n, bucket, counts, tokens, distinct): for each chunk and bucket, its entries' counts in all training rows.

    ``tokens`` and ``distinct`` are the bucket's sums over words, on one of its rows.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n, k, entries, counts = zip(*chunk_of(row, order).packed(buckets), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(entries, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "n", "bucket", "entries", "counts"])

    def added(key: tuple, group: pa.Table) -> pa.Table:
        counts = [np.frombuffer(decompress(c), np.int64) for c in group["counts"].to_pylist()]
        sizes, flat = np.array([len(c) for c in counts]), np.concatenate(counts)
        if key[0].as_py() == 1:
            places = Places()
            back = np.concatenate([np.fromiter(map(places.__getitem__, decompress(e).split(b" ")), np.int64) for e in group["entries"].to_pylist()])
        else:
            back = np.unique(np.concatenate([rising(e) for e in group["entries"].to_pylist()]), return_inverse=True)[1]
        sums = np.bincount(back, weights=flat).astype(np.int64)  # exact up to 2^53
        parts = np.split(sums[back], np.cumsum(sizes)[:-1])
        once = np.arange(len(parts)) == 0
        return pa.table([group["chunk"], group["n"], group["bucket"], pa.array([compress(x.tobytes()) for x in parts], pa.binary()), pa.array(once * int(sums.sum())), pa.array(once * int((sums > 0).sum()))], names=["chunk", "n", "bucket", "counts", "tokens", "distinct"])

    lists = chunks.select("chunk", "held", "sizes", "flat", "words").mapInArrow(listed, "chunk long, n int, bucket int, entries binary, counts binary")
    return lists.groupBy("n", "bucket").applyInArrow(added, "chunk long, n int, bucket int, counts binary, tokens long, distinct long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Token counts, base score and model score, one row per row of ``docs``."""
    chunks = checkpointed(chunked(docs, id_col, text_col))
    buckets = max(LEAST_BUCKETS, (chunks.agg(F.sum("chars")).first()[0] or 0) // BUCKET)
    answers = checkpointed(answered(chunks, buckets, order))
    tokens, distinct = (int(x or 0) for x in answers.where("n = 1").agg(F.sum("tokens"), F.sum("distinct")).first())
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        (row,) = texts.select(["held", "sizes", "flat", "words"]).to_pylist()
        with uncollected():
            chunk = chunk_of(row, order)
            known = {(n, k): c for n, k, c in zip(counts["n"].to_pylist(), counts["bucket"].to_pylist(), counts["counts"].to_pylist(), strict=True)}
            total = {n: chunk.total(n, known, buckets) for n in chunk.keys}
            a = Automaton(chunk, total, tokens, distinct)
            scores = [a.score(t) for t in chunk.texts()]
        ends = np.cumsum(chunk.sizes)
        sums = lambda x: np.add.reduceat(x[chunk.flat], ends - chunk.sizes) - x[0]  # noqa: E731  without the END before each text
        known_tokens = sums((total[1] > 0).astype(np.int64))
        return pa.table(
            [texts["ids"].combine_chunks().flatten(), pa.array(row["held"], pa.bool_()), pa.array(chunk.sizes - 1), pa.array(known_tokens), pa.array(np.full(len(ends), tokens, np.int64)), pa.array(sums(np.log10(a.base))), pa.array(scores)],
            names=["id", "held", "n", "known", "tokens", "base", "score"],
        )

    sides = chunks.drop("chars").groupBy("chunk").cogroup(answers.select("chunk", "n", "bucket", "counts").groupBy("chunk"))
    out = sides.applyInArrow(scored, f"id {kind}, held boolean, n long, known long, tokens long, base double, score double")
    return out.toDF(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
SQL: dict[str, str] = {}
