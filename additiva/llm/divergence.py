"""Source divergence audit: how far each source's use of words departs from that of other sources and of its language.

A plain relational plan. Regexp matches are exploded once and counted by (lang, source, term), together with the number of
documents (in the tasks that read the texts, as that took a third of the time of JVM expressions); terms in ``LEAST_DOCUMENTS`` documents of a language are its kept vocabulary. Groups (lang, source) are crossed
with the vocabulary of their language, so that zeros are rows too; each gets its smoothed share p in billionths.
The pair part joins those rows with themselves on (lang, term) and adds up the divergence of each pair of sources; the
term part compares a group with its language and ranks by window.

How it is dealt out. Occurrences are summed map-side before their first shuffle; the second brings the counts of a
(lang, term) together as one row, which has an entry a source. That row is written to the shared folder, and crossing and
self-join happen inside it, without another shuffle: the sources of the language are joined to it (broadcast if
counted small; else dealt out by ``SALTS`` parts of a language, as a language may hold a third of everything), and its
entries are exploded twice. Sums of pairs are combined map-side. The term part keeps ``TERMS`` rows a group by a rank
in each of ``SALTS`` parts of the group's terms before the rank over all, so no task sorts a whole group.

All arithmetic is on integers; products that may pass 64 bits are decimals of 38 digits.

Defined cases: null text, lang and source are empty texts. A row is a document, so repeated rows count repeatedly. A
group without terms takes part with zeros; a language without kept terms gives pairs of value 0. An empty table gives an
empty result. Other columns are not read, whatever their names. Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from additiva.llm.common import BROADCAST_ROWS, broadcast_if_small, checkpointed, stored, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same rule for bytes: what no term contains becomes a space, capitals small letters.
_TERMS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
LEAST_DOCUMENTS, TERMS, UNIT, SALTS = 3, 200, 1_000_000_000, 64
#: Different (lang, source, term) that a task holds, and rows of a batch that it gives out.
ENTRIES, ROWS = 1 << 19, 1 << 16


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that have it.

    Matches are exploded and counted inside the tasks that read the texts, and given out whenever ``ENTRIES`` different ones are held.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = list(n)
                for k in range(0, len(terms), ROWS):
                    part = terms[k : k + ROWS]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(map(n.__getitem__, part), pa.int64()), pa.array(map(docs.__getitem__, part), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms = text.encode().translate(_TERMS).split()
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held > ENTRIES:
                    yield from out()
                    counts, held = {}, 0
        yield from out()

    rows = docs.select("lang", "source", "text").mapInArrow(of_batches, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """1 + floor(UNIT * (count + 1) / total), exactly: in 64 bits where the product fits, else in decimals."""
    return f"1 + case when {count} < 9000000000 then ({UNIT}L * ({count} + 1)) div ({total}) else (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0)) end"


def departure(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); p and q are at most some 10^9, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def by_language(side: DataFrame, other: DataFrame, entries: int) -> DataFrame:
    """The equi-join on lang with a row for each language of ``entries`` entries in all: broadcast if few, else by parts of a language."""
    if entries <= BROADCAST_ROWS:
        return side.join(F.broadcast(other), "lang")
    dealt = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return side.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(dealt, ["lang", "_part"]).drop("_part")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = checkpointed(named.select("lang", "source").distinct())
    n_groups = groups.count()
    met = counted(named).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = stored(met.where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "lang_n", "by"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    sides = checkpointed(totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources")).join(sizes, "lang"))
    count = "coalesce(try_element_at(counts, s.source), 0L)"
    dense = by_language(kept, sides, n_groups).withColumn("counts", F.map_from_entries("by")).select("lang", F.expr(f"transform(sources, s -> {share(count, 's.total + v')})").alias("ps"))
    twice = dense.select("lang", "ps", F.posexplode("ps").alias("i", "p")).select("lang", "i", "p", F.posexplode("ps").alias("j", "q"))
    sums = twice.where("i <> j").groupBy("lang", "i", "j").agg(F.sum(departure("p", "q")).alias("value"))
    places = sides.select("lang", F.posexplode("sources").alias("i", "s")).select("lang", "i", F.col("s.source").alias("source"))
    sums = sums.join(places, ["lang", "i"]).join(places.toDF("lang", "j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")
    others = groups.join(broadcast_if_small(groups.withColumnRenamed("source", "item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pair_part = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    # Zeros are never above the language's share, so this part needs the occurring terms only.
    groups_of = broadcast_if_small(checkpointed(sides.select("lang", "v", "lang_total", F.explode("sources").alias("s")).select("lang", "s.source", F.expr("s.total + v").alias("total"), F.expr("lang_total + v").alias("whole"))))
    terms_of = kept.select("lang", "term", "lang_n", F.explode("by").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n").join(groups_of, ["lang", "source"])
    shares = terms_of.select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "total")).alias("p"), F.expr(share("lang_n", "whole")).alias("q"))
    above = shares.where("p > q").select("lang", "source", "item", departure("p", "q").alias("value"))
    order = (F.desc("value"), F.asc("item"))
    first = above.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "source", "_part").orderBy(*order))).where(F.col("_r") <= terms)
    term_part = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair_part.unionByName(term_part)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT lang, source, regexp_extract_all(t, '{TERM}') AS w FROM d),
o AS (SELECT lang, source, unnest(w) AS term FROM e),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM e) GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS t FROM l GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(gn.t, 0) + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
q AS (SELECT lang, term, 1 + CAST({UNIT} AS HUGEINT) * (n + 1) // (t + v) AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TERMS}
"""
QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {"op12_source_divergence": OP12_SQL}
