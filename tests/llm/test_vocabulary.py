"""Phrase mining, source divergence and byte-level BPE against plain versions and the library."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from additiva.llm import bytebpe, divergence, phrases

SCHEMA = "doc_id long, text string, lang string, source string"


def clashing(df):
    names = ["shard", "words", "f", "a", "l", "r", "n", "k", "rank", "term", "p", "q", "item", "value", "id", "first", "kind", "bucket"]
    return df.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="module")
def random_docs(spark):
    """Few words, so that phrases repeat; nulls, blanks, repeated rows, ties, one long text, several breaks."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = [rng.choice("the The of a B c d é 中x un_der".split()) for _ in range(rng.randrange(0, 40))]
        rows.append((k, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ""]) for w in words), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])))
    rows += rows[:40] + [(900, None, "en", "s"), (901, "", None, None), (902, " \t ..", "xx", "y"), (903, "a b c d e f g " * 3000, "de", "s"), (904, None, "zz", None)]
    return rows


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for size in range(1, 6):
                f.update((lang, *ws[i : i + size]) for i in range(len(ws) - size + 1))
    wanted = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in wanted.items():
        lang, ws = p[0], p[1:]
        if any(len(o) > len(p) and o[0] == lang and b >= a and any(o[i : i + len(ws)] == ws for i in range(1, len(o))) for o, b in wanted.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]], n[lang]))
    out.sort()
    done, at = [], Counter()
    for lang, score, a, phrase, l, r, total in out:  # noqa: E741
        at[lang] += 1
        if at[lang] <= top:
            done.append((lang, at[lang], phrase.decode(), -a, l, r, total, -score))
    return done


@pytest.mark.parametrize("least, top, parts", [(3, 2000, 1), (3, 25, 7), (40, 2000, 5)])
def test_collocations(spark, random_docs, least, top, parts):
    docs = clashing(spark.createDataFrame(random_docs, SCHEMA)).repartition(parts)
    found = phrases.collocations(*phrases.frequent_phrases(docs, least=least), top=top)
    assert sorted(map(tuple, found.collect())) == sorted(plain_collocations(random_docs, least, top))


def test_phrases_of_nothing(spark):
    for rows in ([], [(1, None, None, None)], [(1, " ,. ", "en", "s")]):
        assert phrases.collocations(*phrases.frequent_phrases(spark.createDataFrame(rows, SCHEMA))).count() == 0
        assert divergence.audit(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_scores_past_64_bits(spark):
    """1000 * a * n and l * r beyond 2^63."""
    big = 3_000_000_000_000
    words = spark.createDataFrame([(1, "en", "x", big), (2, "en", "y", big + 1)], "gid long, lang string, word string, f long")
    found = phrases.collocations(words, spark.createDataFrame([([1, 2], big - 1)], "words array<long>, f long"), spark.createDataFrame([("en", 4 * big)], "lang string, n long")).first()
    assert found["score"] == 1000 * (big - 1) * 4 * big // (big * (big + 1))


def test_bitmaps():
    """Blocks of any size give the popcounts of plain counting."""
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 4, 3000)
    pairs = phrases.Pairs({"gids": phrases.pack(np.array([11, 12, 13])), "flat": phrases.pack(flat)})
    frequent = rng.integers(0, 2, len(pairs.counts))
    good = {(a, b) for a, b, x in zip(pairs.first.tolist(), pairs.second.tolist(), frequent.tolist(), strict=True) if x}
    want = Counter(tuple(w) for size in (3, 4, 5) for i in range(len(flat)) if len(w := flat[i : i + size].tolist()) == size and all(p in good for p in zip(w, w[1:], strict=False)))
    for most in (1, 50, 1 << 18):
        phrases.BLOCK, before = most, phrases.BLOCK
        got = Counter()
        for b in phrases.mined(pairs, frequent):
            got.update(dict(zip(map(tuple, b.phrases.tolist()), b.popcounts.tolist(), strict=True)))
        phrases.BLOCK = before
        assert got == want
    assert np.array_equal(phrases.unpack(phrases.pack(np.zeros(0, np.int64))), np.zeros(0, np.int64))


def test_divergence(spark, random_docs, tmp_path):
    """Against the SQL, on nulls, groups without terms, repeated rows and ties."""
    docs = clashing(spark.createDataFrame(random_docs, SCHEMA))
    docs.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = c.sql(divergence.OP12_SQL)
    found = divergence.audit(docs).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    kinds = {(r["lang"], r["source"], r["part"]) for r in found.collect()}
    assert ("en", "", "pair") in kinds and ("zz", "", "pair") not in kinds


def test_divergence_ranks_few_terms(spark):
    rows = [(k, f"w{k % 9} " * (k % 5 + 1) + f"s{k % 2}", "en", f"s{k % 2}") for k in range(120)]
    found = [r for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), terms=3).collect() if r["part"] == "term"]
    assert {r["rank"] for r in found} <= {1, 2, 3} and {r["source"] for r in found} == {"s0", "s1"}


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.replay(bytebpe.rank_file()).ranks
    return tiktoken.Encoding("own", pat_str=bytebpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_byte_bpe(spark, library):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += [None, "", " \n\t ", "a" * 20_000, "ab" * 9_000, "🙂é中" * 3_000, "it's we'LL x'ſ <|endoftext|>", "one " * 300_000, texts[0], texts[0]]
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit("y"))
    out = bytebpe.round_trip(docs, bytebpe.rank_file(), bytebpe.split_pattern())
    assert Counter(map(tuple, out.collect())) == Counter((k if k % 7 else None, *expected(library, t)) for k, t in enumerate(texts))
    assert bytebpe.round_trip(docs.where("false"), bytebpe.rank_file(), bytebpe.split_pattern()).count() == 0


def test_byte_bpe_random(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcdeiou  \n'sé中🙂ÀЖ0123.,-́‍") for _ in range(rng.randrange(0, 90))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(60_000))]
    split, replay, block = bytebpe.Split(bytebpe.split_pattern()), bytebpe.replay(bytebpe.rank_file()), bytebpe.BLOCK
    for bytebpe.BLOCK in (300, block):
        assert list(bytebpe.digests(texts, bytebpe.Pieces(replay), split)) == [expected(library, t) for t in texts]
    bytebpe.BLOCK = block


def test_byte_bpe_all_code_points(library):
    split, pieces = bytebpe.Split(bytebpe.split_pattern()), bytebpe.Pieces(bytebpe.replay(bytebpe.rank_file()))
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}" for c in range(k, k + 1024)) for k in range(0, 0x110000, 1024) if not 0xD800 <= k < 0xE000]
    assert list(bytebpe.digests(texts, pieces, split)) == [expected(library, t) for t in texts]


def test_merges_in_any_order(monkeypatch):
    """Vocabularies in which a merged token comes before its parts, so that a merge can make a pair of lower rank."""
    for seed in range(60):
        rng = random.Random(seed)
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(50)}
        ranks = {t: k for k, t in enumerate([bytes([b]) for b in range(256)] + rng.sample(sorted(more), len(more)))}
        plain = tiktoken.Encoding("o", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        for many in (1, 1 << 60):
            monkeypatch.setattr(bytebpe, "MANY", many)
            assert bytebpe.Replay(ranks).encode([w.encode() for w in words]) == [plain.encode_ordinary(w) for w in words]
