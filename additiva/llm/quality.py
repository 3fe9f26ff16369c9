"""Quality rules: a threshold table compiled into one projection, without user functions.

``measure`` adds the counts, ``RULES`` is the table (metric, least, most) and ``verdicts`` turns the table into one
boolean column per rule. Everything is a single narrow projection over the scan: no shuffle, no Python.

Defined cases: a null, empty or blank text has zero words and fails the length rule, so it is not kept. A text that is
one huge line, or of millions of words, is measured whole. Repeated rows are measured row by row. An empty table gives
an empty result. Columns other than the identifier and the text are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import BLANKS, table, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is it that for on was with as at by be this are from or an not have he she you they his her we".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este".split(),
}
SYMBOLS = "#*$%&|<>"
LETTER, CAPITALS = r"\p{L}", r"^\P{Ll}*\p{Lu}\P{Ll}*$"

#: The threshold table: metric, least, most (None: open). A text is kept if every metric is inside its bounds. Lengths,
#: symbols, stop words, repeated lines and the shares of words with a letter and all in capitals follow published rules for web text.
RULES = (
    ("n_words", 50, None),
    ("repeat_word_percent", None, 50),
    ("mean_word_length", 1.5, 15.0),
    ("symbol_ratio", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("letter_word_ratio", 0.8, None),
    ("caps_word_ratio", None, 0.5),
)


def with_repeat_words(df: DataFrame, ws: str, out: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Each step is a projection of its own, so that it is evaluated once and the
    sorts are compiled. Texts whose windows are all distinct stop at the distinct count; a few repeated keys are
    looked up window by window; many are found by one sort of (key, position), so no text costs more than n log n.
    """
    w, k, again, at = (F.col(c) for c in (ws, "__k", "__again", "__at"))
    n = F.greatest(F.size(w) - 2, F.lit(1))
    df = df.withColumn("__k", F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct(k)) < F.size(k), F.sort_array(k)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__again", F.array_distinct(F.filter(F.col("__sorted"), lambda x, j: F.get(F.col("__sorted"), j - 1) == x)))
    few = F.filter(F.transform(k, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())
    df = df.withColumn("__ranked", F.when(F.size(again) > 24, F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))))
    r = F.col("__ranked")
    many = F.sort_array(F.transform(F.filter(r, lambda x, j: (F.get(r, j - 1)["k"] == x["k"]) | (F.get(r, j + 1)["k"] == x["k"])), lambda x: x["i"]))
    df = df.withColumn("__at", F.when(F.size(again) == 0, F.array().cast("array<int>")).when(F.size(again) <= 24, few).otherwise(many))
    steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    return df.withColumn(out, F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and metrics, one row per row of ``docs``."""
    text = F.coalesce(F.col("__t"), F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    ws = F.col("__w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).withColumn("__w", words(F.col("__t"))).withColumn("__l", lines)
    narrow = with_repeat_words(narrow, "__w", "n_repeat_words")
    return narrow.select(
        F.col("__id").alias(id_col),
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct(F.col("__l")))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ws, lambda w: w.rlike(LETTER))).cast("long").alias("n_letter_words"),
        F.size(F.filter(ws, lambda w: w.rlike(CAPITALS))).cast("long").alias("n_caps_words"),
    )


def metrics() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_word_percent": 100 * F.col("n_repeat_words") / n,
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "letter_word_ratio": F.col("n_letter_words") / n,
        "caps_word_ratio": F.col("n_caps_words") / n,
    }


def compile_rules(rules=RULES) -> Column:
    """The conjunction of the table's rows as one boolean expression."""
    values, verdict = metrics(), F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict = verdict & (values[name] >= least)
        if most is not None:
            verdict = verdict & (values[name] <= most)
    return verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Metrics with ``base_failed`` and the table's verdict ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_STOPS = ", ".join(sorted({"'" + w + "'" for ws in STOP_WORDS.values() for w in ws}))
OP9_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
             CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words,
             CAST(len(list_filter(ws, lambda x: regexp_matches(x, '^\P{{Ll}}*\p{{Lu}}\P{{Ll}}*$'))) AS BIGINT) AS n_caps_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 15 * n_words AND n_symbols <= 0.3 * n_words
          AND n_stop_words >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_letter_words >= 0.8 * n_words AND n_caps_words <= 0.5 * n_words AS kept
FROM f
"""
QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": OP9_SQL}
