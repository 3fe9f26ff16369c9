"""The pipeline against a plain version of its stages, and its rules for stages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from additiva.llm import secrets, simhash, toxicity

DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD))


def clean_of_toxic(spark, docs):
    model = toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    out = {}
    for i, r in docs.items():
        k, v = toxicity.sparse(r["text"], toxicity.Places())
        if not len(k) or toxicity.severity(model, np.array([toxicity.weighed(k, v, model.evidence) @ model.weights[k]]))[0] < model.reject:
            out[i] = r
    return out


def one_of_each(docs):
    fps = {i: simhash.fingerprint(r["text"]) for i, r in docs.items()}
    parent = {i: i for i in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in docs:
        for j in docs:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: r for i, r in docs.items() if top(i) == i}


def without_items(docs, items):
    grams = lambda w: Counter(" ".join(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for i, r in docs.items():
        w, bad = ws(r["text"]), False
        for b in items:
            target = grams(b)
            if target & grams(w):
                for s in range(max(1, len(w) - len(b) + 1)):
                    g = grams(w[s : s + len(b)])
                    bad |= sum(len(x) * c for x, c in (g & target).items()) >= 0.8 * sum(len(x) * c for x, c in (g | target).items())
        if not bad:
            out[i] = r
    return out


def redacted(docs):
    rules = [(re.compile(secrets.ASSIGN[4:], re.I | re.A), 6, 2, 2), (re.compile("AKIA[A-Z0-9]+"), 20, 0, 0), (re.compile("[0-9a-f]+"), 24, 0, 0), (re.compile("[A-Za-z0-9+/_=-]+"), 20, 0, 0)]
    found = {}
    for i, r in docs.items():
        spans = []
        for k, (p, least, size, value) in enumerate(rules):
            for m in p.finditer(r["text"]):
                v = m[value]
                if len(m[size]) < least or k == 3 and (not all(re.search(c, v) for c in ("[0-9]", "[A-Z]", "[a-z]")) or len(set(v)) < 10 or any(a < m.end() and m.start() < b for a, _, b, _ in spans)):
                    continue
                spans.append((m.start(), k, m.end(), v))
        found[i] = sorted(spans)
    owners, repos = {}, {}
    for i, spans in found.items():
        for *_, v in spans:
            owners.setdefault(v, set()).add(docs[i]["source"])
            repos.setdefault(v, set()).add((docs[i]["source"], i))
    out = {}
    for i, r in docs.items():
        at, text = 0, ""
        for a, k, b, v in found[i]:
            live = len(owners[v]) < 2 or len(owners[v]) < 3 and len(repos[v]) < 10
            if k == 3 and not live:
                continue
            if a >= at:
                text += r["text"][at:a] + ("[SECRET]" if live else "[EXAMPLE]")
            at = max(at, b)
        out[i] = text + r["text"][at:]
    return out


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    docs = pd.read_parquet(f"{DIR}/documents.parquet").set_index("doc_id").to_dict("index")
    items = [ws(x) for x in pd.read_parquet(f"{DIR}/benchmark.parquet").text]
    kept = redacted(without_items(one_of_each(clean_of_toxic(spark, docs)), items))
    want = {}
    for i, text in kept.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert found == want and 0.5 * len(docs) < len(found) < len(docs)


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert np.isin([n for n, _ in corpus_pipeline.STAGES], ["toxicity", "near_dedup", "decontamination", "secret_scans", "bpe"]).all()


def test_toxicity_is_fitted_in_a_task(spark):
    """The driver gets the model, whose size does not depend on the texts, and not their features."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = []
    kinds = (type(spark.range(1)).toArrow, type(spark.range(1)).collect)
    try:
        type(docs).toArrow = lambda self: held.append("arrow") or kinds[0](self)
        type(docs).collect = lambda self: held.append(self.columns) or kinds[1](self)
        model = toxicity.train(docs, labels)
    finally:
        type(docs).toArrow, type(docs).collect = kinds
    assert model is not None and len(model.weights) == toxicity.SPACE
    assert "arrow" not in held and held[-1] == ["evidence", "weights", "thresholds", "reject"]
