"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from tracemill.llm import alignment, decontaminate, language, negatives, neighbours, packing, pii, quality, rules, simhash, toxicity, urls, warc

MODULES = (simhash, language, toxicity, decontaminate, quality, pii, packing, warc, neighbours, urls, alignment, negatives, rules)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
