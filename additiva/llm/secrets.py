"""Secret scans with corpus-wide ownership frequency.

Base findings are regular expressions over the whole text (``KINDS``). The method adds a broader kind, ``token``
(random-looking strings of mixed case and digits), which alone would flag documentation examples. So every candidate's
hash is aggregated over the corpus by distinct repositories and distinct owners: a value that ``EXAMPLE_OWNERS`` or
more owners have, or that two share over ``EXAMPLE_REPOS`` or more repositories, is a widely copied example; one that
stays with fewer is live-looking (however many repositories of one owner have it). Added candidates are reported if
live-looking; base findings always stay and are counted by class. A document is taken as a repository of the owner in
``source``.

Everything is DataFrame functions. Offsets are code points and come from the pieces between matches, added up in blocks
of ``BLOCK``, so that a text with n matches costs some n * BLOCK small steps (and n / BLOCK squared for the sums of blocks), not n
squared copies; each expression over a whole text is bound once and not evaluated again for its parts. Counts are
pre-aggregated by (hash, owner, repository), then (hash, owner), then hash, so a value in a third of all rows meets
no single task; the class is joined back with plain equi-joins that adaptive execution may split.

Defined cases: a null text is empty and gives zero counts, no spans and the digest of the empty string. A null owner
counts as one owner, null repositories as one. Repeated rows count once as repository and each get their own result
row. An empty table gives an empty result. ``redact`` keeps every row and column; other columns, whatever their names,
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from additiva.llm.common import checkpointed, table, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose value is the secret. In the order in which spans of one start are listed.
KINDS = (("assign", ASSIGN, 2), ("access", r"(AKIA[A-Z0-9]{16,})", 1), ("hex", r"([0-9a-f]{24,})", 1))
ADDED = ("token", r"(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,})", 1)
LEAST_VALUE, LEAST_DISTINCT, EXAMPLE_OWNERS, EXAMPLE_REPOS, BLOCK = 6, 10, 3, 10, 128
#: Characters of a block of text that is cut apart.
CHARS = 2048
#: Spans and rows with spans up to which they are broadcast to the texts.
BROADCAST_SPANS = 500_000
NONE = "array<struct<start:int,rank:int,kind:string,end:int,hash:bigint>>"


def _in_blocks(xs: Column) -> Column:
    """The array cut into arrays of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK), F.lit(0)).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))


def _running(xs: Column) -> Column:
    """Sums of the numbers before each element."""
    return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: lambdas evaluate what they name again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind: leftmost, not overlapping, dropped afterwards if the value is too short."""
    whole, values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    # The last piece has no match after it: it meets null and goes.
    sizes = F.filter(F.zip_with(between, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"))), lambda x: x["size"].isNotNull())
    each = F.zip_with(sizes, values, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")))

    def spans(block, start):
        inside = _running(F.transform(block, lambda x: x["gap"] + x["size"]))
        keep = lambda s: F.length(s["value"]) >= least
        if kind == ADDED[0]:
            keep = lambda s: F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_DISTINCT
        at = lambda x, i: start + i + x["gap"]
        placed = F.zip_with(block, inside, lambda x, i: F.struct(at(x, i).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at(x, i) + x["size"]).alias("end"), x["value"].alias("value")))
        return F.transform(F.filter(placed, keep), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("hash")))

    def in_order(blocks):
        before = _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["size"])))
        return F.flatten(F.zip_with(blocks, before, spans))

    return F.when(text.rlike(pattern), _once(each, lambda xs: _once(_in_blocks(xs), in_order))).otherwise(F.array().cast(NONE))


def with_candidates(docs: DataFrame, text_col: str, base: str, added: str) -> DataFrame:
    """Adds the base spans and the further candidates that overlap none of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [_found(text, k, kind, pattern, group, LEAST_VALUE if kind == "assign" else 1) for k, (kind, pattern, group) in enumerate(KINDS)]
    df = docs.withColumn(base, F.concat(*every)).withColumn(added, _found(text, len(KINDS), *ADDED, 1))
    # Sorted base spans in blocks with their bounds: a candidate looks into the blocks that it meets only.
    bounds = lambda xs: F.transform(_in_blocks(xs), lambda b: F.struct(F.get(b, 0)["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans")))
    meets = lambda x, c: (x["start"] < c["end"]) & (c["start"] < x["end"])
    apart = _once(F.sort_array(F.col(base)), lambda xs: _once(bounds(xs), lambda blocks: F.filter(F.col(added), lambda c: ~F.exists(blocks, lambda b: meets(b, c) & F.exists(b["spans"], lambda s: meets(s, c))))))
    return df.withColumn(added, F.when((F.size(added) > 0) & (F.size(base) > 0), apart).otherwise(F.col(added)))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from rows (hash, owner, repo)."""
    by_owner = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def is_example(owners: Column, repos: Column) -> Column:
    return (owners >= EXAMPLE_OWNERS) | ((owners > 1) & (repos >= EXAMPLE_REPOS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Candidates of each row, without texts, in the checkpoint folder: (id, same, owner, base, added)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    return checkpointed(with_candidates(narrow, "text", "base", "added").select("id", F.xxhash64("text").alias("same"), "owner", "base", "added"))


def reported(rows: DataFrame) -> DataFrame:
    """(id, same, start, rank, kind, end, live): the reported spans of rows with candidates, equal rows once."""
    found = rows.select("id", "same", F.coalesce("owner", F.lit("")).alias("owner"), F.explode(F.concat("base", "added")).alias("s")).select("id", "same", "owner", "s.*")
    wide = ownership(found.select("hash", "owner", F.col("id").alias("repo")))
    each = found.select("id", "same", "start", "rank", "kind", "end", "hash").distinct().join(wide, "hash")
    each = each.withColumn("live", ~is_example(F.col("n_owners"), F.col("n_repos"))).where(F.col("live") | (F.col("rank") < len(KINDS)))
    return each.select("id", "same", "start", "rank", "kind", "end", "live")


def classified(rows: DataFrame) -> DataFrame:
    """(id, same, spans) for rows with candidates: all reported spans in order, each with its class ``live``."""
    return reported(rows).groupBy("id", "same").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "live"))).alias("spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Counts, base digest, spans and class counts, one row per row of ``docs``."""
    rows = scan(docs, id_col, text_col, owner_col)
    known = classified(rows).withColumnRenamed("id", "k_id").withColumnRenamed("same", "k_same")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,live:boolean>>"))
    classes = lambda live: F.size(F.filter(spans, lambda s: s["live"] == live)).cast("long")
    return rows.join(known, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("same") == F.col("k_same")), "left").select(
        F.col("id").alias(id_col),
        *(count(kind) for kind, _, _ in KINDS),
        F.sha2(_text(F.sort_array("base")), 256).alias("base_sha256"),
        _text(spans).alias("spans"),
        classes(True).alias("n_live"),
        classes(False).alias("n_example"),
    )


def cuts(rows: DataFrame) -> DataFrame:
    """(id, same, cuts, tail): what replaces parts of a text, in order, as (start, since, live): the text from ``since`` to ``start`` stays
    and a mark follows; the text from ``tail`` on stays. A span that begins inside an earlier one adds no mark."""
    order = Window.partitionBy("id", "same").orderBy("start", "rank")
    spans = reported(rows).withColumn("since", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = F.when(F.col("start") >= F.col("since"), F.struct("start", "since", "live"))
    return spans.groupBy("id", "same").agg(F.sort_array(F.collect_list(kept)).alias("cuts"), F.max("end").alias("tail"))


def _marked(text: Column, spans: Column, tail: Column) -> Column:
    """The text with its marks. It is cut into blocks of ``CHARS`` characters once, so that a part costs its own length and two blocks."""

    def part(blocks, at, end):
        first = F.floor(at / CHARS).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / CHARS).cast("int") - first + 1), "")
        return F.when(end > at, F.substring(held, at - first * CHARS + 1, end - at)).otherwise(F.lit(""))

    def joined(blocks):
        pieces = F.transform(spans, lambda c: F.concat(part(blocks, c["since"], c["start"]), F.when(c["live"], "[SECRET]").otherwise("[EXAMPLE]")))
        return F.concat(F.array_join(pieces, ""), part(blocks, tail, F.length(text)))

    return _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), joined)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with every reported span replaced by ``[SECRET]`` (live-looking) or ``[EXAMPLE]``.

    The texts are searched once. Rows with spans are broadcast if their spans are counted to be few, so that texts
    stay where they are; beyond that the join is by shuffle.
    """
    spans, same, key, tail = (unused(c, docs) for c in ("__spans", "__same", "__key", "__tail"))
    known = checkpointed(cuts(scan(docs, id_col, text_col, owner_col)).toDF(key, same, spans, tail))
    total = known.agg(F.count("*") + F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()[0]
    side = F.broadcast(known) if total <= BROADCAST_SPANS else known
    hit = docs.join(side, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(same)), "left")
    text = F.col(text_col)
    return hit.withColumn(text_col, F.when(F.size(spans) > 0, _marked(text, F.col(spans), F.col(tail))).otherwise(text)).select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rules for DuckDB. Runs of the added kind are matched whole and then tested, as its expressions know no lookaround."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [*((k, kind, p, g) for k, (kind, p, g) in enumerate(KINDS)), (len(KINDS), ADDED[0], "([A-Za-z0-9+/_=-]{20,})", 1)]
    found = " UNION ALL ".join(f"SELECT doc_id, owner, {k} AS r, '{kind}' AS kind, regexp_extract_all(t, {quoted(p)}, 0) AS m, regexp_extract_all(t, {quoted(p)}, {g}) AS v, string_split_regex(t, {quoted(p)}) AS gap FROM d" for k, kind, p, g in kinds)
    count = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
p AS (SELECT doc_id, owner, r, kind, v[i] AS v, length(m[i]) AS n,
  CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
q AS (SELECT *, a + n AS z FROM p WHERE CASE r WHEN 0 THEN length(v) >= {LEAST_VALUE} WHEN {len(KINDS)} THEN
  regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT} ELSE true END),
c AS (SELECT * FROM q WHERE r < {len(KINDS)} UNION ALL SELECT * FROM q x WHERE r = {len(KINDS)} AND NOT EXISTS (SELECT 1 FROM q y WHERE y.r < {len(KINDS)} AND y.doc_id = x.doc_id AND y.a < x.z AND x.a < y.z)),
o AS (SELECT v, NOT (owners >= {EXAMPLE_OWNERS} OR owners > 1 AND repos >= {EXAMPLE_REPOS}) AS live FROM (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repos FROM c GROUP BY v)),
s AS (SELECT c.*, live, kind || ':' || a || ':' || z AS span FROM c JOIN o USING (v) WHERE r < {len(KINDS)} OR live),
g AS (SELECT doc_id, {count}, string_agg(span, ',' ORDER BY a, r) FILTER (r < {len(KINDS)}) AS base, string_agg(span, ',' ORDER BY a, r) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind, _, _ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op1_secret_scans": op1_secret_scans}
SQL = {"op1_secret_scans": _sql()}
