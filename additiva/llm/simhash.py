"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits come from hashed word shingles. Two texts link if their fingerprints differ in at most
``RADIUS`` (3) bits; a component is what links reach. Copies of one fingerprint are one node throughout, so a group of
equal texts of any size costs one node and one row per document.

Links are found with variants within half the radius, level by level. Of two fingerprints at distance 3 or less, one
32-bit half differs in one bit at most. Meet in the middle on that half: every fingerprint emits its half itself, and
if the half has an even number of set bits also its 32 one-bit variants; halves one bit apart differ in parity, so
they meet. Where variants collide, the other half is met in the same way: it differs in 3 bits at most (2 if the first
half differs), so within a collision every fingerprint emits the variants of its other half within one bit, and those
of odd parity within two bits. A full variant then names a point z of Hamming space, and all that emitted it lie within
two bits of z. A fingerprint within one bit of z (a centre) is within 3 of all others there, so a star from the
smallest centre links them: rows stay linear in the variants and no pairs of a group are spelled out. A group at z
holds 561 x 33 fingerprints at most, whatever the input. Each star link is checked by its Hamming distance.

Why it is complete: let x, y be within 3. Some key half K differs in d <= 1 bits, so x and y meet at a key which one
of them carries unchanged. The rest differs in e <= 3 - d bits. If e <= 2 both emit the variant in the middle within
one bit (for e = 2) or one of them (e <= 1); if e = 3 (d = 0) their parities differ and the odd one emits two bits.
Either way one of them that carries the key unchanged is within one bit of z, so a centre exists and both get a star.

That first level prunes while halves of 32 bits seldom meet by chance. From ``DIRECT_FROM`` distinct fingerprints on
they would, so the balls are emitted directly (counted, not guessed; both ways give the same components): a
fingerprint of even parity emits its 65 variants within one bit; one of odd parity these and its 992 variants whose two
flipped bits lie in one half. Two fingerprints at distance 3 differ in parity and two of the three bits lie in one
half, so the odd one flips these and the even one the third; at distance 2 both meet in the middle. That is 561 rows a
fingerprint at any size.

Components come from alternating large-star and small-star rounds on the distinct fingerprints, each written to the
checkpoint folder; the number of rounds grows with the logarithm of the longest chain.

Defined cases: a null text counts as empty; texts without words share fingerprint zero and are linked like any other;
fewer words than a shingle give one feature, the whole sequence. Repeated rows give repeated result rows. A null
identifier is ignored when the smallest is taken unless a component has no other. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import LOWER, UPPER, broadcast_if_small, checkpointed, table, text_parts, unused

SHINGLE, SEED, RADIUS = 3, 42, 3
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Distinct fingerprints from which variants of whole fingerprints are emitted at once.
DIRECT_FROM = 1 << 26
#: Hashes whose bits are counted at once; bounds the memory that a very long text takes.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    ws = (text or "").encode().translate(_FOLD).split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[k:] for k in range(shingle)), strict=False)) if len(ws) >= shingle else iter([b" ".join(ws)])
    digest, n, counts = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    while len(hashes := np.fromiter((digest(s, seed) for s in islice(shingles, _CHUNK)), np.uint64)):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Identifier, ``same`` (a hash of the text) and ``fp`` (the fingerprint as a signed long), one row per row of ``docs``."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["id", "same", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"))
    return narrow.mapInArrow(of_batches, f"id {narrow.schema['id'].dataType.simpleString()}, same long, fp long")


def _flips(value, bits: int = 32):
    """``value`` and its one-bit variants."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _stars(points: DataFrame, at: list[str]) -> DataFrame:
    """Links (a, b) from the least centre to all that emitted the same point: rows (*at, fp, near), ``near`` if fp is within a bit of it."""
    centre = F.when(F.col("near"), F.col("fp"))
    stars = points.groupBy(*at).agg(F.min(centre).alias("centre"), F.collect_set("fp").alias("members")).where("centre IS NOT NULL AND size(members) > 1")
    found = stars.select("centre", F.explode("members").alias("fp")).where("fp <> centre").select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b")).distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def direct_links(fps: DataFrame) -> DataFrame:
    """Star links from variants of whole fingerprints."""
    fp = F.col("fp")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    half = lambda base: F.flatten(F.transform(F.sequence(F.lit(base), F.lit(base + 30)), lambda i: F.transform(F.sequence(i + 1, F.lit(base + 31)), lambda j: fp.bitwiseXOR(one(i)).bitwiseXOR(one(j)))))
    ball = _flips(fp, 64)
    points = fps.select("fp", F.posexplode(F.when(F.bit_count("fp") % 2 == 1, F.concat(ball, half(0), half(32))).otherwise(ball)).alias("k", "z"))
    return _stars(points.select("z", "fp", (F.col("k") <= 64).alias("near")), ["z"])


def links(fps: DataFrame, direct: bool = False) -> DataFrame:
    """Star links (a, b), a > b as signed longs, among the distinct values of ``fp`` that keep components."""
    if direct:
        return direct_links(fps)
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("side"), low.alias("key"), high.alias("rest")))).alias("h")).select("fp", "h.*")
    even = F.bit_count("key") % 2 == 0
    keyed = halves.select("fp", "side", "rest", F.posexplode(F.when(even, _flips(F.col("key"))).otherwise(F.array("key"))).alias("off", "key")).withColumn("off", F.when(F.col("off") > 0, 1).otherwise(0))
    # Only keys that several fingerprints reach, one of them with its half unchanged, are looked at further.
    shared = keyed.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("off").alias("least")).where("n > 1 AND least = 0").select("side", "key")
    met = keyed.join(shared, ["side", "key"])
    rest = F.col("rest")
    bits = F.sequence(F.lit(0), F.lit(31))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: rest.bitwiseXOR(one(i)).bitwiseXOR(one(j)))))
    ball = F.concat(F.array(rest), F.transform(bits, lambda i: rest.bitwiseXOR(one(i))))
    wide = (F.col("off") == 0) & (F.bit_count("rest") % 2 == 1)
    points = met.select("fp", "side", "key", "off", F.posexplode(F.when(wide, F.concat(ball, two)).otherwise(ball)).alias("k", "z"))
    near = (F.col("off") == 0) & (F.col("k") <= 32)
    return _stars(points.select("side", "key", "z", "fp", near.alias("near")), ["side", "key", "z"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b), a > b, except roots; the root is the smallest node reachable.

    Rounds grow with the logarithm of the longest chain; should ``most_rounds`` not do, that is an error and no result.
    """
    edges = checkpointed(edges)
    finished = edges.isEmpty()
    for _ in range(most_rounds):
        if finished:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b"), "a").toDF("x", "y", "z")
        after = small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(small.select(F.col("z"), F.col("y"))).where("a <> b").distinct()
        after = checkpointed(after)
        # Stable once every node has one parent and no parent has a parent.
        roots = after.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        chained = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        edges, finished = after, roots <= 1 and chained
    if not finished:
        raise RuntimeError(f"components are unfinished after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, same, fp, component, chosen), one row per row of ``docs``; ``chosen`` is the text hash of the component's least row."""
    rows = checkpointed(with_fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "same")).alias("least")))
    found = components(links(nodes.select("fp"), nodes.count() >= DIRECT_FROM))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.id").alias("component"), F.col("first.same").alias("chosen"))
    return rows.join(rooted.join(least, "root").select("fp", "component", "chosen"), "fp").select("id", "same", "fp", "component", "chosen")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``."""
    return labelled(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: that of the smallest identifier, then text hash.

    Equal texts share a component, so (identifier, text hash) names one component: rows compete only inside it.
    Rows to drop are found as such pairs; only repeated rows of a kept pair are shuffled for a choice.
    """
    key, same = unused("__id", docs), unused("__same", docs)
    rows = checkpointed(labelled(docs, id_col, text_col, shingle))
    least = F.col("id").eqNullSafe(F.col("component")) & (F.col("same") == F.col("chosen"))
    drop = rows.where(~least).select("id", "same").distinct().toDF(key, same)
    again = rows.where(least).groupBy("id", "same").count().where("count > 1").select("id", "same").toDF(key, same)
    again = checkpointed(again)
    by_pair = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(same))
    kept = docs.join(broadcast_if_small(checkpointed(drop)), by_pair, "left_anti")
    if again.isEmpty():
        return kept
    small = broadcast_if_small(again)
    once = kept.join(small, by_pair, "left_semi").withColumn(same, F.xxhash64(text_col)).dropDuplicates([id_col, same]).drop(same)
    return kept.join(small, by_pair, "left_anti").unionByName(once)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
SQL: dict[str, str] = {}
