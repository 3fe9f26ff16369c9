"""Phrase collocation mining: position bitmaps per word, extended depth-first, popcounts summed over shards.

Shards. Rows are cut into shards of some ``SHARD`` characters in the partitions they lie in. A shard is a vector of words
with a break between pieces, so that each phrase is a bitmap over its places: the places where it ends.

Bitmaps. They are sparse, so they are kept compressed, as rising lists of their set bits, those of many phrases one after the
other (``Bitmaps``). Extending phrases by a word is a shift by one place, AND with the bitmaps of words and of places that may
be reached (same piece, pair frequent); what remains is split by the word that stands there, and the popcounts are the
lengths of the parts. Phrases are extended depth-first, a block of sibling bitmaps at a time (``mined``), to ``LONGEST`` words.

Sums. A phrase that is frequent in the corpus may be rare in each shard, so no shard can leave anything out by itself. Words
are summed first, then pairs of frequent words; only then phrases of three to five words are mined, in which every pair is
frequent in the corpus: any part of a frequent phrase is frequent. Popcounts go to hash buckets, packed by (shard, bucket);
a bucket's task adds them up and, for words and pairs, tells each shard which of its own are frequent. Nothing is broadcast or
collected; a task holds one shard or one bucket, and the number of buckets grows with the text. A frequent word or pair is one
entry a shard in its bucket. Identifiers of frequent words are numbers that the buckets give, so sums know no hash collisions.

Scores are relational: candidates meet their parts by equi-joins (parts of a frequent phrase are in the table of frequent
phrases), the lowest cut is a minimum, and a candidate falls to a longer one that occurs as often by an anti-join. Arithmetic
is on decimals of 38 digits. Ranks are taken in ``SALTS`` parts of a language first, so that no task sorts a whole language.

Defined cases: a null text is empty, a null language ``und``. Repeated rows count each time. An empty table gives an empty
result. Other columns are not read, whatever their names. Whole texts are read; a text longer than a shard is a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from additiva.llm.common import LOWER, UPPER, broadcast_if_small, checkpointed, table
from additiva.llm.lm import compress, decompress

LEAST, LONGEST, TOP, SALTS = 100, 5, 2000, 64
#: Characters of a shard, characters of text for each bucket, least number of buckets, and set bits of a block of bitmaps.
SHARD, BUCKET, LEAST_BUCKETS, BLOCK = 8_000_000, 16_000_000, 32, 1 << 18
BREAKS = ".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans((UPPER + BREAKS + "\t").encode(), (LOWER + "\n" * len(BREAKS) + " ").encode())
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte in planes, compressed."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + compress(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
        out *= _STEP
        out ^= out >> np.uint64(32)
    return out


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the buckets that are not empty, in order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    kinds, at = np.unique(bucket[by], return_index=True)
    if len(kinds):
        yield from zip(kinds.tolist(), np.split(by, at[1:]), strict=True)


def undealt(hashes: np.ndarray, buckets: int, answers: list[np.ndarray]) -> np.ndarray:
    """The buckets' answers, which are in order of the buckets, at the places of the entries."""
    by = np.argsort((hashes % np.uint64(buckets)).astype(np.int64), kind="stable")
    out = np.zeros(len(by), np.int64)
    if answers:
        out[by] = np.concatenate(answers)
    return out


def same_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct row, number of the row at each place), exactly."""
    key = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        other = np.unique(c, return_inverse=True)[1]
        key = np.unique(key * (int(other.max(initial=0)) + 1) + other, return_inverse=True)[1]
    first = np.unique(key, return_index=True)[1]
    return first, key


class _Words(dict):
    def __init__(self, every: list[bytes]) -> None:
        super().__init__({b"": 0, b"\n": 1})
        self.every = every

    def __missing__(self, word: bytes) -> int:
        self.every.append(word)
        found = self[word] = len(self.every) + 1
        return found


class Shard:
    """Distinct words of each language, and the texts as places in that list: 1 is a break, words begin at 2."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.languages: dict[str, _Words] = {}
        self.owners: list[str] = []
        self.parts: list[np.ndarray] = []

    def add(self, text: str | None, lang: str | None) -> None:
        lang = "und" if lang is None else lang
        words = self.languages.get(lang)
        if words is None:
            words = self.languages[lang] = _Words(self.words)
        tokens = (text or "").encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
        self.owners += [lang] * (len(self.words) - len(self.owners))
        self.parts.append(np.append(found[found > 0], np.int32(1)))

    def row(self, number: int, chars: int) -> pa.RecordBatch:
        names = {lang: k for k, lang in enumerate(dict.fromkeys(self.owners))}
        columns = [pa.array([number]), pa.array([chars]), pa.array([list(names)], pa.list_(pa.string())), pa.array([pack(np.array([names[x] for x in self.owners], np.int64))]), pa.array([compress(b" ".join(self.words))]), pa.array([pack(np.concatenate(self.parts))])]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "chars", "langs", "owners", "words", "flat"])


def sharded(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(shard, chars, langs, owners, words, flat): rows cut into shards where they lie."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, shard = TaskContext.get().partitionId() << 32, 0, Shard()
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if size and size + len(text or "") > SHARD:
                    yield shard.row(number, size)
                    number, size, shard = number + 1, 0, Shard()
                shard.add(text, lang.as_py())
                size += len(text or "") + 1
        if size:
            yield shard.row(number, size)

    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return narrow.mapInArrow(of_batches, "shard long, chars long, langs array<string>, owners binary, words binary, flat binary")


class Listed:
    """The words of a shard's row by bucket."""

    def __init__(self, row: dict) -> None:
        self.flat = unpack(row["flat"])
        self.words = decompress(row["words"]).split(b" ") if len(self.flat) and self.flat.max() > 1 else []
        langs = [x.encode() + b" " for x in row["langs"]]
        # A word has no space, so the last one ends the language.
        self.named = [langs[k] + w for k, w in zip(unpack(row["owners"]).tolist(), self.words, strict=True)] if self.words else []
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.named), np.uint64, len(self.named))


def batch(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


def summed_words(shards: DataFrame, buckets: int, least: int) -> DataFrame:
    """Three kinds of rows: ids of each shard's words by bucket (0: not frequent), the frequent words, and all words by language."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Listed(row)
                counts = np.bincount(s.flat, minlength=len(s.words) + 2)[2:]
                rows = [(row["shard"], k, compress(b"\n".join([s.named[i] for i in at.tolist()])), pack(counts[at])) for k, at in dealt(s.hashes, buckets)]
                yield batch("shard bucket entries counts", [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    def added(key: tuple, group: pa.Table) -> pa.Table:
        bucket, places, back = key[0].as_py(), {}, []
        for entries in group["entries"].to_pylist():
            back.append(np.array([places.setdefault(w, len(places)) for w in decompress(entries).split(b"\n")], np.int64))
        counts = [unpack(c) for c in group["counts"].to_pylist()]
        sums = np.bincount(np.concatenate(back), weights=np.concatenate(counts), minlength=len(places)).astype(np.int64)  # exact up to 2^53
        frequent = sums >= least
        ids = np.where(frequent, np.cumsum(frequent) * buckets + bucket, 0)
        rows = [(0, shard, bucket, pack(ids[b]), None, None, None, None) for shard, b in zip(group["shard"].to_pylist(), back, strict=True)]
        every: dict[bytes, int] = {}
        for w, n, g in zip(places, sums.tolist(), ids.tolist(), strict=True):
            lang, word = w.rsplit(b" ", 1)
            every[lang] = every.get(lang, 0) + n
            if g:
                rows.append((1, None, bucket, None, g, lang.decode(), word.decode(), n))
        rows += [(2, None, bucket, None, None, lang.decode(), None, n) for lang, n in every.items()]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.Table.from_batches([batch("kind shard bucket ids gid lang word f", kinds, rows)])

    lists = shards.select("shard", "langs", "owners", "words", "flat").mapInArrow(listed, "shard long, bucket int, entries binary, counts binary")
    return lists.groupBy("bucket").applyInArrow(added, "kind int, shard long, bucket int, ids binary, gid long, lang string, word string, f long")


def numbered(shards: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """(shard, gids, flat): ids of the shard's frequent words, rising, and its places: 0 a break or other words, else a place among those."""

    def of_shard(texts: pa.Table, counts: pa.Table) -> pa.Table:
        (row,) = texts.to_pylist()
        s = Listed(row)
        known = sorted(zip(counts["bucket"].to_pylist(), counts["ids"].to_pylist(), strict=True))
        ids = undealt(s.hashes, buckets, [unpack(x) for _, x in known])
        gids = np.unique(ids[ids > 0])
        local = np.concatenate([[0, 0], np.where(ids > 0, np.searchsorted(gids, ids) + 1, 0)])[s.flat]
        # One break is enough between words.
        local = local[(local > 0) | (np.append(1, local[:-1]) > 0)]
        return pa.Table.from_batches([batch("shard gids flat", [pa.int64(), pa.binary(), pa.binary()], [(row["shard"], pack(gids), pack(local))])])

    sides = shards.select("shard", "langs", "owners", "words", "flat").groupBy("shard").cogroup(answers.groupBy("shard"))
    return sides.applyInArrow(of_shard, "shard long, gids binary, flat binary")


class Pairs:
    """The distinct pairs of frequent neighbours of a shard, and the place of the second word of each occurrence."""

    def __init__(self, row: dict) -> None:
        self.gids, self.flat = unpack(row["gids"]), unpack(row["flat"])
        self.size = len(self.gids) + 1
        self.at = np.flatnonzero((self.flat[1:] > 0) & (self.flat[:-1] > 0)) + 1
        keys, self.pair, self.counts = np.unique(self.flat[self.at - 1] * self.size + self.flat[self.at], return_inverse=True, return_counts=True)
        self.first, self.second = keys // self.size, keys % self.size
        self.columns = [self.gids[self.first - 1], self.gids[self.second - 1]] if len(keys) else [np.zeros(0, np.int64)] * 2
        self.hashes = hashed(self.columns)


class Bitmaps:
    """Compressed bitmaps of phrases of equal length: ``phrases`` (a row each), and their set bits, rising, one list after the other."""

    def __init__(self, phrases: np.ndarray, bits: np.ndarray, popcounts: np.ndarray) -> None:
        self.phrases, self.bits, self.popcounts = phrases, bits, popcounts

    def blocks(self, most: int) -> Iterator[Bitmaps]:
        """Whole bitmaps of some ``most`` set bits together."""
        ends = np.cumsum(self.popcounts)
        cuts = np.flatnonzero(np.diff(ends // most, append=-1)) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            yield Bitmaps(self.phrases[a:b], self.bits[(ends[a - 1] if a else 0) : ends[b - 1]], self.popcounts[a:b])

    def extended(self, words: np.ndarray, reachable: np.ndarray) -> Bitmaps:
        """Shift by a place, AND with what is reachable and with each word's bitmap (``words`` has the word of each bit)."""
        shifted = self.bits + 1
        kept = reachable[shifted]
        bits, phrase = shifted[kept], np.repeat(np.arange(len(self.popcounts)), self.popcounts)[kept]
        key = phrase * (int(words.max(initial=0)) + 1) + words[bits]
        by = np.argsort(key, kind="stable")
        _, first, popcounts = np.unique(key[by], return_index=True, return_counts=True)
        first = by[first]
        return Bitmaps(np.column_stack([self.phrases[phrase[first]], words[bits[first]]]), bits[by], popcounts)


def mined(pairs: Pairs, frequent: np.ndarray, longest: int = LONGEST) -> Iterator[Bitmaps]:
    """Bitmaps of all phrases of 3 to ``longest`` words whose pairs are frequent, depth-first."""
    good = frequent[pairs.pair].astype(bool)
    bits, pair = pairs.at[good], pairs.pair[good]
    if not len(bits):
        return
    reachable = np.zeros(len(pairs.flat) + 1, bool)
    reachable[bits] = True
    by = np.argsort(pair, kind="stable")
    kinds, popcounts = np.unique(pair[by], return_counts=True)
    roots = Bitmaps(np.column_stack([pairs.first[kinds], pairs.second[kinds]]), bits[by], popcounts)
    for root in roots.blocks(BLOCK):
        stack = [root]
        while stack:
            more = stack.pop().extended(pairs.flat, reachable)
            if len(more.popcounts):
                yield more
                if more.phrases.shape[1] < longest:
                    stack.append(more)


def add_up(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each distinct phrase, its sum, number of the phrase at each place)."""
    first, back = same_rows(columns)
    return first, np.bincount(back, weights=counts, minlength=len(first)).astype(np.int64), back


def listed_phrases(shard: int, columns: list[np.ndarray], counts: np.ndarray, buckets: int) -> list[tuple]:
    return [(shard, len(columns), k, [pack(c[at]) for c in columns], pack(counts[at])) for k, at in dealt(hashed(columns), buckets)]


LISTS, LIST_KINDS = "shard size bucket entries counts", [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.binary()]
LIST_SCHEMA = "shard long, size int, bucket int, entries array<binary>, counts binary"


def summed_phrases(lists: DataFrame, least: int, answer: bool) -> DataFrame:
    """The frequent phrases (kind 1: words, f); with ``answer`` also which of a shard's own are frequent (kind 0: shard, bucket, ids)."""

    def added(key: tuple, group: pa.Table) -> pa.Table:
        size, bucket = key[0].as_py(), key[1].as_py()
        entries, counts = group["entries"].to_pylist(), [unpack(c) for c in group["counts"].to_pylist()]
        columns = [np.concatenate([unpack(e[k]) for e in entries]) for k in range(size)]
        first, sums, back = add_up(columns, np.concatenate(counts))
        good = sums >= least
        rows = [(1, None, bucket, None, words, n) for words, n in zip(np.column_stack([c[first[good]] for c in columns]).tolist(), sums[good].tolist(), strict=True)]
        if answer:
            ends = np.cumsum([len(c) for c in counts])[:-1]
            rows += [(0, shard, bucket, pack(part), None, None) for shard, part in zip(group["shard"].to_pylist(), np.split(good[back].astype(np.int64), ends), strict=True)]
        return pa.Table.from_batches([batch("kind shard bucket ids words f", [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()], rows)])

    return lists.groupBy("size", "bucket").applyInArrow(added, "kind int, shard long, bucket int, ids binary, words array<long>, f long")


def pair_lists(texts: DataFrame, buckets: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = Pairs(row)
                yield batch(LISTS, LIST_KINDS, listed_phrases(row["shard"], p.columns, p.counts, buckets))

    return texts.mapInArrow(listed, LIST_SCHEMA)


def longer_lists(texts: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def of_shard(state: pa.Table, counts: pa.Table) -> pa.Table:
        (row,) = state.to_pylist()
        p = Pairs(row)
        known = sorted(zip(counts["bucket"].to_pylist(), counts["ids"].to_pylist(), strict=True))
        frequent = undealt(p.hashes, buckets, [unpack(x) for _, x in known])
        by_size: dict[int, list[Bitmaps]] = {}
        for found in mined(p, frequent):
            by_size.setdefault(found.phrases.shape[1], []).append(found)
        rows = []
        for size, parts in by_size.items():
            phrases = np.concatenate([b.phrases for b in parts])
            rows += listed_phrases(row["shard"], [p.gids[phrases[:, k] - 1] for k in range(size)], np.concatenate([b.popcounts for b in parts]), buckets)
        return pa.Table.from_batches([batch(LISTS, LIST_KINDS, rows)])

    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(of_shard, LIST_SCHEMA)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words (gid, lang, word, f), phrases (words, f), totals (lang, n)): all that occur ``least`` times in a language."""
    shards = checkpointed(sharded(docs, text_col, lang_col))
    buckets = max(LEAST_BUCKETS, (shards.agg(F.sum("chars")).first()[0] or 0) // BUCKET)
    first = checkpointed(summed_words(shards, buckets, least))
    texts = checkpointed(numbered(shards, first.where("kind = 0").select("shard", "bucket", "ids"), buckets))
    second = checkpointed(summed_phrases(pair_lists(texts, buckets), least, True))
    longer = checkpointed(summed_phrases(longer_lists(texts, second.where("kind = 0").select("shard", "bucket", "ids"), buckets), least, False))
    phrases = second.where("kind = 1").select("words", "f").unionByName(longer.select("words", "f"))
    return first.where("kind = 1").select("gid", "lang", "word", "f"), phrases, first.where("kind = 2").groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(words: DataFrame, phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` candidates."""
    part = lambda at, size: F.slice("words", at, size)
    # Parts of longer candidates that occur as often as these.
    places = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), s -> slice(words, s, n))))")
    covered = phrases.where("size(words) > 2").select("f", F.explode(places).alias("words")).distinct()
    kept = checkpointed(phrases.join(covered, ["words", "f"], "left_anti"))
    units = broadcast_if_small(checkpointed(words.select(F.array("gid").alias("u"), F.col("f").alias("uf")).unionByName(phrases.select(F.col("words").alias("u"), F.col("f").alias("uf")))))
    cut = kept.select("words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.size("words")))
    cut = cut.join(units.toDF("left", "l"), "left").join(units.toDF("right", "r"), "right").select("words", "a", "k", "l", "r")
    named = broadcast_if_small(words.select(F.col("gid").alias("w"), "lang", "word"))
    spelled = kept.select("words", F.posexplode("words").alias("at", "w")).join(named, "w").groupBy("words").agg(F.min("lang").alias("lang"), F.concat_ws(" ", F.expr("transform(array_sort(collect_list(struct(at, word))), x -> x.word)")).alias("phrase"))
    scored = cut.join(spelled, "words").join(broadcast_if_small(totals), "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    least = scored.withColumn("score", score).groupBy("lang", "words", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    rows = least.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(table(spark, sf_dir, "documents")))


def _sql() -> str:
    levels = [f"SELECT lang, w[i:i + {k - 1}] AS p, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 2 - {k})) AS i FROM w WHERE len(w) >= {k}) GROUP BY ALL HAVING count(*) >= {LEAST}" for k in range(1, LONGEST + 1)]
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY ALL),
u AS ({' UNION ALL '.join(levels)}),
c AS (SELECT lang, p, f AS a FROM u WHERE len(p) > 1),
s AS (SELECT DISTINCT lang, p[i:j] AS p, a FROM (SELECT *, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT *, unnest(range(1, len(p))) AS i FROM c WHERE len(p) > 2)) WHERE j - i + 1 < len(p)),
z AS (SELECT *, unnest(range(1, len(p))) AS k FROM c ANTI JOIN s USING (lang, p, a)),
v AS (SELECT z.lang, z.p, z.a, z.k, x.f AS l, y.f AS r, n.n, 1000 * CAST(z.a AS HUGEINT) * n.n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM z JOIN u x ON x.lang = z.lang AND x.p = z.p[1:z.k] JOIN u y ON y.lang = z.lang AND y.p = z.p[z.k + 1:] JOIN n ON n.lang = z.lang),
m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT *, array_to_string(p, ' ') AS phrase FROM m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""


QUERIES = {"op11_phrase_mining": op11_phrase_mining}
SQL = {"op11_phrase_mining": _sql()}
