"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from additiva.llm import bpe, bytebpe, decontaminate, divergence, html, langid, lm, phrases, quality, secrets, sharding, simhash, toxicity

MODULES = (secrets, bpe, decontaminate, lm, sharding, html, simhash, langid, quality, toxicity, phrases, divergence, bytebpe)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
