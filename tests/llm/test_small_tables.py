"""Every operator on awkward small tables: nulls, empty and long texts, repeats, ties, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from additiva.llm import bpe, decontaminate, html, langid, lm, quality, secrets, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word other thing " * 20_000
ROWS = [
    (1, "The cat and the dog of the house. " * 8, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n ", "en", "b", 4), (5, LONG, "en", "a", None),
    (1, "The cat and the dog of the house. " * 8, "en", "a", 1), (None, "Der Hund und die Katze.", "de", "c", 5), (None, None, None, None, None), (6, "é ß 中文 🙂", "de", "c", 5), (7, "one", "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named like those that the operators make."""
    names = ["id", "same", "fp", "w", "size", "shard", "spans", "base", "score", "n_words", "__id", "__key", "__same", "rid", "held", "start", "window"]
    return df.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "the cat and the dog of the house. the cat and"), (1, None), (2, " "), (3, "Katze."), (4, "nobody has these seven words at all")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, lab, ben: secrets.find_secrets(d),
    "redact": lambda d, lab, ben: secrets.redact(d),
    "bpe": lambda d, lab, ben: bpe.round_trip(d, bpe.tokenizer_spec()),
    "lm": lambda d, lab, ben: lm.score(d),
    "sharding": lambda d, lab, ben: sharding.place(d, sharding.topology(4)),
    "simhash": lambda d, lab, ben: simhash.near_duplicates(d),
    "langid": lambda d, lab, ben: langid.predict(d, langid.train(d)),
    "quality": lambda d, lab, ben: quality.judge(d),
    "toxicity": lambda d, lab, ben: toxicity.score(d, toxicity.train(d, lab)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(docs, empty, labels, benchmark, name):
    f = OPERATORS[name]
    out = f(docs, labels, benchmark)
    assert out.count() == len(ROWS)
    plain = sorted(map(repr, out.collect()))
    # Other columns change nothing, whatever their names.
    assert sorted(map(repr, f(clashing(docs), labels, benchmark).select(*out.columns).collect())) == plain
    assert f(empty, labels, benchmark).count() == 0


def test_filters(docs, empty, labels, benchmark):
    wide = clashing(docs)
    kept = decontaminate.clean(wide, benchmark)
    assert kept.columns == wide.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3, 4, 5, 6, 7]
    assert decontaminate.clean(empty, benchmark).count() == 0 and decontaminate.clean(docs, benchmark.where("false")).count() == len(ROWS)
    found = {(r["id"], r["item"]): r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(found) == {(1, 0), (None, 3)} and found[1, 0]["similarity"] == 1 and found[1, 0]["start"] == 0
    one = simhash.keep_one(wide)
    assert one.columns == wide.columns
    # Texts 2, 3, 4 and one without identifier have no words; both rows of 1 are one group.
    assert sorted(r["doc_id"] or -1 for r in one.collect()) == [-1, 1, 2, 5, 6, 7]
    assert simhash.keep_one(empty).count() == 0
    clean = toxicity.keep_clean(wide, toxicity.train(docs, labels))
    assert clean.columns == wide.columns and toxicity.keep_clean(empty, None).count() == 0


def test_unrelated_rows_of_one_identifier_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4]), (1, texts[4]), (2, texts[4])]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(out.collect(), key=lambda r: r["text"]) == [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4])]


def test_defined_values(docs):
    q = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert q[2]["n_words"] == 0 and q[2]["base_failed"] and not q[2]["kept"] and q[5]["n_words"] == 60_000 and q[5]["n_repeat_words"] == 60_000
    s = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert s[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and s[2]["spans"] == ""
    p = sharding.place(docs, sharding.topology(4)).collect()
    assert {r["size"] for r in p if r["doc_id"] == 2} == {1} and {r["text_crc32"] for r in p if r["doc_id"] == 2} == {0}
    by = {}
    for r in p:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    n = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert n[2]["fingerprint"] == "0" * 16 and n[2]["component_id"] == n[3]["component_id"] == n[4]["component_id"] == 2
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect() if r["doc_id"] in (2, 3, 4)} == {"und"}


def test_pages(spark):
    rows = [(1, "u", "<article><h1>T</h1><p>One, two &amp; three.</p></article>"), (2, None, None), (2, "u", ""), (None, "u", "no tags at all, here"), (3, "u", "<p>" + "long text, and more. " * 50_000)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    texts = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert len(out) == 5 and texts[1, "u"] == "T\nOne, two & three." and texts[2, None] == "" and texts[None, "u"] == "no tags at all, here" and len(texts[3, "u"]) == 21 * 50_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
