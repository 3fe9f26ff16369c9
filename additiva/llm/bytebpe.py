"""Byte-level BPE by merge replay over a block of the corpus, and decoding.

Texts are cut into pieces by the split pattern; a block gathers pieces of many texts (``BLOCK`` of them, or a part of one
long text) and encodes its distinct new ones together. All their bytes lie in one vector of places, linked inside
each piece. An inverted index leads from the rank that a pair of neighbours would merge to, to the places where such a pair
begins. The ranks present are taken in rising order; each is applied at all its places, leftmost first, and only the
two pairs that the merged token touches are looked up and entered anew. So a pair that stands in a thousand pieces is
found once, and work is (merges done) times a small number, however long a piece is.

The result is that of merging each piece by itself, lowest rank first and leftmost among equals: before a rank r is applied
a piece has no pair below r; where a merge makes one below r, that one is applied at once, before the next place
(``_at_once``). Pieces that are tokens themselves are that token, as in the library.

A block and the tokens of pieces met before (two generations of ``KNOWN``) bound a task's memory, with some 20 bytes for
each byte of a piece longer than that. Rows stay in the partitions they lie in: there is no shuffle, and a lost task is
repeated from its input. An index over the whole corpus at once would need a shuffle of each text's pieces; a block gives
the same tokens.

Defined cases: a null text is empty and gives no tokens; an empty table gives an empty result; repeated rows are encoded
row by row; other columns are not read, whatever their names. Nothing is cut from long texts.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from heapq import heappop, heappush
from itertools import islice
from re import Pattern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.bpe import compiled
from additiva.llm.common import table

#: Pieces of a block, pieces remembered in a generation, and characters of the longest one remembered.
BLOCK, KNOWN, LONGEST = 1 << 19, 1 << 18, 64
#: Places of a rank from which they are merged together, and what sets the parts of a pair's key apart.
MANY, SHIFT = 16, 1 << 24


class Replay:
    """Encoder and decoder of a vocabulary of byte strings with ranks; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes_of = ranks, {k: b for b, k in ranks.items()}
        self.numbers = {k: str(k) for k in self.bytes_of}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of every pair of tokens that merges to a token, by left * SHIFT + right.
        self.pairs = {ranks[w[:k]] * SHIFT + ranks[w[k:]]: r for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
        keys, values = (np.fromiter(x, np.int64, len(self.pairs)) for x in (self.pairs, self.pairs.values()))
        by = np.argsort(keys)
        self.keys, self.values = np.append(keys[by], -1), np.append(values[by], -1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that neighbours merge to, or -1."""
        key = left * SHIFT + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        whole = self.ranks.get
        out: list[list[int]] = [[k] if (k := whole(p)) is not None else [] for p in pieces]
        todo = [k for k, ids in enumerate(out) if not ids and pieces[k]]
        if not todo:
            return out
        ends = np.cumsum([len(pieces[k]) for k in todo])
        starts = np.append(0, ends[:-1])
        n = int(ends[-1])
        # Token (-1: merged into one before), next and previous place of each place, and the rank due between it and the
        # next one (-1: none). The arrays are for places one at a time, the views on them for many.
        self.token = array("q", self.first[np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)].tobytes())
        self.after, self.before, self.due = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", bytes(8 * n))
        self.tokens, self.afters, self.befores, self.dues = (np.frombuffer(x, np.int64) for x in (self.token, self.after, self.before, self.due))
        self.dues[:-1] = self.rank_of(self.tokens[:-1], self.tokens[1:])
        self.afters[ends - 1] = self.befores[starts] = self.dues[ends - 1] = -1
        self.index: dict[int, array] = {}
        self.heap: list[int] = []
        self._enter_all(self.dues, np.arange(n))
        while self.heap:
            r = heappop(self.heap)
            places = self.index.pop(r)
            if len(places) < MANY or not self._merge_all(np.sort(np.frombuffer(places, np.int64)), r):
                for p in sorted(places):
                    if self.due[p] == r:
                        self._at_once(self._merge(p, r), r)
        alive = self.tokens >= 0
        tokens, at = self.tokens[alive].tolist(), 0
        for k, m in zip(todo, np.add.reduceat(alive, starts, dtype=np.int64).tolist(), strict=True):
            out[k] = tokens[at : at + m]
            at += m
        return out

    def _merge(self, p: int, r: int) -> list[tuple[int, int]]:
        """Merges the pair at p; gives the (rank, place) of touched pairs below r and enters the others."""
        token, after, due = self.token, self.after, self.due
        q = after[p]
        token[p], token[q], due[q], after[p] = r, -1, -1, after[q]
        if after[p] >= 0:
            self.before[after[p]] = p
        early = []
        for left in (self.before[p], p):
            if left < 0:
                continue
            new = due[left] = self.pairs.get(token[left] * SHIFT + token[after[left]], -1) if after[left] >= 0 else -1
            if 0 <= new < r:
                early.append((new, left))
            elif new >= 0:
                self._places(new).append(left)
        return early

    def _places(self, r: int) -> array:
        places = self.index.get(r)
        if places is None:
            places = self.index[r] = array("q")
            heappush(self.heap, r)
        return places

    def _enter_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        some = np.flatnonzero(ranks >= 0)
        if not len(some):
            return
        by = some[np.argsort(ranks[some], kind="stable")]
        kinds, at = np.unique(ranks[by], return_index=True)
        data, ends = places[by].astype(np.int64), [*at[1:].tolist(), len(by)]
        for r, a, b in zip(kinds.tolist(), at.tolist(), ends, strict=True):
            self._places(r).frombytes(data[a:b].tobytes())

    def _merge_all(self, places: np.ndarray, r: int) -> bool:
        """Merges at all places together; False, with nothing done, if they touch each other or make a pair below r."""
        p = places[self.dues[places] == r]
        if len(p) > 1 and not (p[1:] > p[:-1]).all():
            p = np.unique(p)
        if not len(p):
            return True
        q = self.afters[p]
        right, left = self.afters[q], self.befores[p]
        if len(p) > 1 and ((q[:-1] >= p[1:]) | (right[:-1] == p[1:])).any():
            return False
        r_left = np.where(left >= 0, self.rank_of(self.tokens[left], np.int64(r)), -1)
        r_right = np.where(right >= 0, self.rank_of(np.int64(r), self.tokens[right]), -1)
        if ((r_left >= 0) & (r_left < r) | (r_right >= 0) & (r_right < r)).any():
            return False
        self.tokens[p], self.tokens[q], self.dues[q], self.afters[p], self.dues[p] = r, -1, -1, right, r_right
        self.befores[right[right >= 0]] = p[right >= 0]
        self.dues[left[left >= 0]] = r_left[left >= 0]
        self._enter_all(np.concatenate([r_left, r_right]), np.concatenate([left, p]))
        return True

    def _at_once(self, early: list[tuple[int, int]], r: int) -> None:
        """Applies pairs below the rank that is being applied, lowest first, until the piece has none."""
        while early:
            low, p = min(early)
            early.remove((low, p))
            if self.due[p] == low:
                early += self._merge(p, low)
                # Pairs between this rank and the outer one cannot wait for their turn, which is over.
                for q in (self.before[p], p):
                    if q >= 0 and low <= self.due[q] < r and (self.due[q], q) not in early:
                        early.append((self.due[q], q))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def replay(spec: str) -> Replay:
    """From the text of a rank file: a token in base 64 and its rank in each line."""
    lines = (line.split() for line in spec.splitlines())
    return Replay({base64.b64decode(parts[0]): int(parts[1]) for parts in lines if parts})


class Split:
    """A split pattern with the classes of the library's Unicode version."""

    def __init__(self, pattern: str) -> None:
        self.of_last = cache(lambda last: compiled(pattern, last))

    def of(self, text: str) -> Pattern:
        """The pattern for a text: a smaller one if it has no code point above U+FFFF."""
        return self.of_last(0xFFFF if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else 0x10FFFF)


class Pieces:
    """Pieces with their number of tokens, ids as text and decoded bytes; encodes the new ones of a block together."""

    def __init__(self, vocabulary: Replay) -> None:
        self.vocabulary, self.known, self.old = vocabulary, {}, {}

    def of(self, pieces: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """The entries of all ``pieces``."""
        found, new = {}, []
        for p in set(pieces):
            entry = self.known.get(p) or self.old.get(p)
            if entry is None:
                new.append(p)
            else:
                found[p] = entry
        decode, number = self.vocabulary.decode, self.vocabulary.numbers.__getitem__
        for p, ids in zip(new, self.vocabulary.encode([p.encode() for p in new]), strict=True):
            found[p] = (len(ids), ",".join(map(number, ids)), decode(ids))
        short = {p: e for p, e in found.items() if len(p) <= LONGEST}
        if len(self.known) + len(short) > KNOWN:
            self.old, self.known = self.known, {}
        self.known.update(short)
        return found


class _Row:
    """Running digests of one text."""

    def __init__(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, entries: list[tuple[int, str, bytes]]) -> None:
        if entries:
            sizes, ids, data = zip(*entries, strict=True)
            self.ids.update((("," if self.n else "") + ",".join(ids)).encode())
            self.n += sum(sizes)
            self.text.update(b"".join(data))


def digests(texts: Iterable[str | None], pieces: Pieces, split: Split) -> Iterator[tuple[int, str, str]]:
    """(number of tokens, digest of the ids, digest of the decoded text) of each text, block by block."""
    held: list[tuple[_Row, list[str]]] = []
    size = 0

    def done() -> Iterator[tuple[int, str, str]]:
        entries = pieces.of([p for _, part in held for p in part])
        for row, part in held:
            row.add([entries[p] for p in part])
        for row in dict.fromkeys(row for row, _ in held[:-1]):
            if row is not held[-1][0]:
                yield row.n, row.ids.hexdigest(), row.text.hexdigest()

    for text in texts:
        text, row = text or "", _Row()
        pattern = split.of(text)
        found = pattern.finditer(text)
        while True:
            part = [m.group() for m in islice(found, BLOCK)] if len(text) > BLOCK else pattern.findall(text)
            held.append((row, part))
            size += len(part)
            if size >= BLOCK:
                yield from done()
                # The last text may go on in the next block.
                held, size = [(row, [])], 0
            if len(text) <= BLOCK or len(part) < BLOCK:
                break
    if held:
        held.append((_Row(), []))
        yield from done()


def round_trip(docs: DataFrame, spec: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, one row per row of ``docs``.

    ``spec`` is the rank file's text: it travels with the task, so executors need no file of the driver.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = Pieces(replay(spec)), Split(pattern)
        for b in batches:
            rows = list(digests((t.as_py() for t in b.column(1)), pieces, split))
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["id", "n", "a", "b"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(of_batches, f"id {narrow.schema['id'].dataType.simpleString()}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def rank_file(path: str | None = None) -> str:
    """Text of a rank file; the default is the public vocabulary for many languages."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, encoding="ascii") as f:
        return f.read()


def split_pattern() -> str:
    """The pattern that belongs to the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), rank_file(), split_pattern())


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
SQL: dict[str, str] = {}
