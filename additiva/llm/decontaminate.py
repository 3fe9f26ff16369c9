"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item is compared with windows of its own number of words by the weighted similarity: sum of the smaller
over sum of the larger multiplicities of five-word shingles, a shingle weighing its characters.

1. Windows. A window can reach the similarity only if the places where it has one of the item's shingles weigh that
   share of the item. Every start for which they do is a window, wherever it lies; no other can reach it.
2. Fingerprints. Distinct windows and items get a 64-bit SimHash of their words, weighing their characters. Words are coarser than
   shingles: an edited word changes one word and five shingles, so long copies of similarity 0.8 differ in some 4 bits, by
   shingles in some 10; short ones, in which a word weighs more, in up to 13.
3. Multi-index blocks. Cut into ``RADIUS + 1`` blocks, two fingerprints within ``RADIUS`` bits agree on one block at
   least, so an equi-join on (words, block, value) finds all of them. Blocks are 4 bits, so a window meets some two thirds of the
   items of its own number of words; windows are few, as step 1 has weighed them. This index is the source of candidates; it
   finds nine in ten edited copies of similarity 0.8 to 0.95 at least (test).
4. What escapes. A fingerprint can lie beyond any radius. Pairs of step 1 that the index did not give are
   further than ``RADIUS`` bits apart, and only those are verified besides; ``path`` says which way a pair came.
5. Verification. Shingle counts of windows and items are joined and the similarity is computed exactly, once for each
   distinct window (shingles are told apart by 64-bit hashes, windows by MD5).

Everything is DataFrame functions. Document shingles stream through the scan's own stage into the (broadcast if
counted small) benchmark shingles; only hits are shuffled, without texts, and texts with hits are read again.

Defined cases: a null or blank item or text matches nothing. An item of fewer than five words has one shingle, the
whole item. A window that would cross an end of its document is moved inside; a shorter document is one window.
Repeated rows of a document count once in ``contaminated``; ``clean`` keeps or drops each of them alike. An empty
table gives an empty result (an empty benchmark leaves all documents clean). Other columns pass through ``clean``
untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import BROADCAST_ROWS, ascii_lower, broadcast_if_small, checkpointed, table, unused, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15


def _run(ws: str, at: Column, g: int) -> tuple[Column, Column]:
    """Hash and weight (characters, with the blanks between) of ``g`` words."""
    each = [F.get(F.col(ws), at + j) for j in range(g)]
    return F.xxhash64(*each), reduce(lambda x, y: x + y, (F.length(w) for w in each), F.lit(g - 1))


def runs(df: DataFrame, ws: str, sizes: list[int], keep: list[str], weighed: bool = True) -> DataFrame:
    """(*keep, g, p, h, c): size, place, hash and weight of every run of ``sizes`` words. Compiled after the explode, not by lambdas."""
    n = F.size(ws)
    placed = df.where(n >= min(sizes)).select(*keep, ws, F.explode(F.sequence(F.lit(0), n - min(sizes))).alias("p"))
    parts = []
    for g in sizes:
        h, c = _run(ws, F.col("p"), g)
        parts.append(F.struct(F.lit(g).alias("g"), h.alias("h"), *([c.alias("c")] if weighed else [])))
    if len(parts) == 1:
        return placed.select(*keep, "p", parts[0].alias("x")).select(*keep, "p", "x.*")
    return placed.where("p >= 0").select(*keep, ws, "p", F.explode(F.array(*parts)).alias("x")).where(F.col("p") + F.col("x.g") <= F.size(ws)).select(*keep, "p", "x.*")


def shingle_sizes(items: DataFrame) -> list[int]:
    """The sizes of shingles that items have, at most ``SHINGLE`` values."""
    return sorted(r[0] for r in items.select(F.least("m", F.lit(SHINGLE)).alias("g")).distinct().collect()) or [SHINGLE]


def shingle_counts(df: DataFrame, key: str, ws: str, sizes: list[int]) -> DataFrame:
    """(key, h, n, c): the shingles of each text, with multiplicity and weight. A text shorter than a shingle is one."""
    dealt = runs(df.withColumn("__g", F.least(F.size(ws), F.lit(SHINGLE))), ws, sizes, [key, "__g"]).where("g = __g")
    return dealt.repartition(key).groupBy(key, "h").agg(F.count("*").alias("n"), F.first("c").alias("c"))


def word_counts(df: DataFrame, key: str, ws: str) -> DataFrame:
    """(key, h, n, c): the words of each text, with multiplicity and characters."""
    return runs(df, ws, [1], [key]).repartition(key).groupBy(key, "h").agg(F.count("*").alias("n"), F.first("c").alias("c"))


def fingerprints(counts: DataFrame, key: str) -> DataFrame:
    """(key, total, fp): a bit is set if the features whose hashes have it weigh over half of the text."""
    w = F.col("n") * F.col("c")
    sums = [F.sum(F.when(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1)) == 1, w).otherwise(0)).alias(f"b{k}") for k in range(64)]
    bit = lambda k: F.when(2 * F.col(f"b{k}") > F.col("total"), F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return counts.groupBy(key).agg(F.sum(w).alias("total"), *sums).select(key, "total", reduce(lambda x, y: x.bitwiseOR(y), map(bit, range(64))).alias("fp"))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """The fingerprint's blocks; two fingerprints within ``radius`` bits share one at least."""
    ends = [64 * k // (radius + 1) for k in range(radius + 2)]
    mask = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(mask(b - a)) for a, b in zip(ends, ends[1:], strict=False)))


def near_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(wid, key) of windows (wid, m, fp) and items (key, m, fp) of equal size within ``radius`` bits."""
    keyed = items.select("key", "m", F.col("fp").alias("ifp"), F.posexplode(blocks(F.col("fp"), radius)).alias("k", "v"))
    met = windows.select("wid", "m", "fp", F.posexplode(blocks(F.col("fp"), radius)).alias("k", "v")).join(broadcast_if_small(keyed), ["m", "k", "v"])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("wid", "key").distinct()


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, key, iw, m): words of the items; equal texts have one key."""
    items = benchmark.select(F.col(id_col).alias("item"), words(ascii_lower(F.col(text_col))).alias("iw")).where("size(iw) > 0")
    return checkpointed(items.distinct().withColumn("m", F.size("iw")).withColumn("key", F.xxhash64(F.array_join("iw", " "))))


def windows(docs: DataFrame, items: DataFrame, counts: DataFrame, sizes: list[int], id_col: str, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """(id, same, key, m, start, wid, ww): every window of an item's size whose shared shingles weigh enough for ``least``.

    ``items`` are (key, iw, m), one row for each text, ``counts`` their shingles. A window's shared weight is at most
    that of its places whose shingle the item has, and similarity ``least`` needs that share of the item's weight.
    """
    need = counts.groupBy("key").agg((F.sum(F.col("n") * F.col("c")) * least - 1e-6).alias("need"))
    met = counts.select("key", "h", "c").join(need, "key").join(items.select("key", "m"), "key").withColumn("g", F.least("m", F.lit(SHINGLE)))
    met = broadcast_if_small(checkpointed(met))
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), words(ascii_lower(F.col(text_col))).alias("w")).withColumn("total", F.size("w"))
    hits = runs(narrow, "w", sizes, ["id", "same", "total"], weighed=False).join(met, ["g", "h"])
    # A group is what one document shares with one item. Starts are sought for each place as the leftmost hit of a window.
    by_item = hits.groupBy("id", "same", "key", "m", "total", "g", "need").agg(F.array_sort(F.collect_set(F.struct("p", "c"))).alias("hits"))
    by_item = by_item.where(F.aggregate("hits", F.lit(0), lambda t, x: t + x["c"]) >= F.col("need")).withColumn("span", F.col("m") - F.col("g"))
    near = by_item.select("id", "same", "key", "m", "total", "need", "span", "hits", F.posexplode("hits").alias("k", "x"))
    before = F.coalesce(F.when(F.col("k") > 0, F.get("hits", F.col("k") - 1)["p"]), F.lit(-1))
    near = near.select("id", "same", "key", "m", "need", "span", F.slice("hits", F.col("k") + 1, F.col("span") + 1).alias("hits"), F.greatest(before + 1, F.col("x.p") - F.col("span")).alias("first"), F.least(F.col("x.p"), F.greatest(F.lit(0), F.col("total") - F.col("m"))).alias("last"))
    near = near.where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("start"))
    shared = F.aggregate("hits", F.lit(0), lambda t, x: t + F.when(x["p"] <= F.col("start") + F.col("span"), x["c"]).otherwise(0))
    # All starts of a document travel together, so that its words are found once.
    starts = near.where(shared >= F.col("need")).groupBy("id", "same").agg(F.collect_set(F.struct("key", "m", "start")).alias("starts")).toDF("i", "t", "starts")
    starts = checkpointed(starts)
    if (starts.agg(F.sum(F.size("starts") + 2)).first()[0] or 0) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    again = texts.join(starts, F.col("id").eqNullSafe(F.col("i")) & (F.col("same") == F.col("t")))
    again = again.dropDuplicates(["id", "same"]).select("id", "same", words(ascii_lower(F.col("text"))).alias("w"), "starts")
    again = again.select("id", "same", "w", F.explode("starts").alias("x")).select("id", "same", "x.*", F.expr("slice(w, x.start + 1, x.m)").alias("ww"))
    return again.withColumn("wid", F.md5(F.array_join("ww", " ")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, same, item, start, m, distance, similarity, path): the best window of each document for each item it contains, and
    whether the index gave it (``index``) or it is beyond its radius (``beyond``)."""
    named = items_of(benchmark)
    items = checkpointed(named.select("key", "iw", "m").dropDuplicates(["key"]))
    sizes = shingle_sizes(items)
    own = checkpointed(shingle_counts(items, "key", "iw", sizes))
    marks = checkpointed(fingerprints(word_counts(items, "key", "iw"), "key").select("key", "fp").join(items.select("key", "m"), "key"))
    weights = checkpointed(own.groupBy("key").agg(F.sum(F.col("n") * F.col("c")).alias("itotal")))
    found = checkpointed(windows(docs, items, own, sizes, id_col, text_col, least))
    distinct = found.select("wid", "m", "ww").dropDuplicates(["wid"])
    counts = checkpointed(shingle_counts(distinct, "wid", "ww", sizes))
    prints = fingerprints(word_counts(distinct, "wid", "ww"), "wid").select("wid", "fp").join(distinct.select("wid", "m"), "wid")
    prints = checkpointed(prints.join(counts.groupBy("wid").agg(F.sum(F.col("n") * F.col("c")).alias("total")), "wid"))
    near = checkpointed(near_pairs(prints, marks, radius))
    beyond = found.select("wid", "key").distinct().join(near, ["wid", "key"], "left_anti")
    pairs = near.withColumn("path", F.lit("index")).unionByName(beyond.withColumn("path", F.lit("beyond")))
    shared = pairs.join(counts, "wid").join(broadcast_if_small(own.select("key", "h", F.col("n").alias("k"))), ["key", "h"]).groupBy("wid", "key", "path").agg(F.sum(F.col("c") * F.least("n", "k")).alias("shared"))
    sides = shared.join(prints.select("wid", "total", "fp"), "wid").join(broadcast_if_small(marks.select("key", F.col("fp").alias("ifp")).join(weights, "key")), "key")
    exact = sides.select("wid", "key", "path", (F.col("shared") / (F.col("total") + F.col("itotal") - F.col("shared"))).alias("similarity"), F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))).alias("distance")).where(F.col("similarity") >= least)
    met = found.select("id", "same", "key", "m", "start", "wid").join(exact, ["wid", "key"]).join(broadcast_if_small(named.select("key", "item")), "key")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "m", (-F.col("distance")).alias("close"), "path")).alias("b")
    return met.groupBy("id", "same", "item").agg(best).select("id", "same", "item", (-F.col("b.before")).alias("start"), F.col("b.m").alias("m"), (-F.col("b.close")).alias("distance"), F.col("b.similarity").alias("similarity"), F.col("b.path").alias("path"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    key, same = unused("__id", docs), unused("__same", docs)
    bad = checkpointed(contaminated(docs, benchmark, id_col, text_col).select(F.col("id").alias(key), F.col("same").alias(same)).distinct())
    return docs.join(broadcast_if_small(bad), F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(same)), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "m")).alias("b")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), (-F.col("b.before")).cast("long").alias("start_word"), F.col("b.m").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity")
    )


#: Every item-sized window, at whatever start, that shares a shingle with an item of its size, compared exactly, without fingerprints. Items have five words at least there.
OP3_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
bs AS (SELECT item_id, len(w) AS m, i - 1 AS q, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
ds AS (SELECT doc_id, len(w) AS n, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hits AS (SELECT DISTINCT doc_id, m, start FROM (SELECT doc_id, m, unnest(range(greatest(0, p - m + 5), least(p, greatest(0, n - m)) + 1)) AS start FROM ds JOIN (SELECT DISTINCT m, s FROM bs) USING (s))),
win AS (SELECT hits.*, d.w[start + 1:start + m] AS ww FROM hits JOIN d USING (doc_id)),
wg AS (SELECT doc_id, m, start, array_to_string(ww[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(ww) - 3)) AS i FROM win)),
wc AS (SELECT doc_id, m, start, s, count(*) AS c FROM wg GROUP BY ALL),
bc AS (SELECT item_id, m, s, count(*) AS c FROM bs GROUP BY ALL),
wt AS (SELECT doc_id, m, start, sum(length(s) * c) AS t FROM wc GROUP BY ALL),
bt AS (SELECT item_id, m, sum(length(s) * c) AS t FROM bc GROUP BY ALL),
both_ AS (SELECT doc_id, m, start, item_id, sum(length(s) * least(wc.c, bc.c)) AS x FROM wc JOIN bc USING (m, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, m, start, x / (wt.t + bt.t - x) AS similarity FROM both_ JOIN wt USING (doc_id, m, start) JOIN bt USING (item_id, m))
SELECT doc_id, item_id, CAST(arg_max(start, (similarity, -start)) AS BIGINT) AS start_word, CAST(max(m) AS BIGINT) AS n_words, round(max(similarity), 6) AS similarity
FROM sim WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id
"""
QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {"op3_decontamination": OP3_SQL}
