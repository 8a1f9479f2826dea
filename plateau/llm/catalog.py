"""Queries of this subpackage and the SQL that checks them where SQL can say the same."""

from plateau.llm import decontaminate, exact_dedup, hard_negatives, html_text, language, line_dedup, mixing, near_dedup, quality, ranked, token_store, toxicity, warc

MODULES = (quality, toxicity, decontaminate, html_text, near_dedup, warc, line_dedup, token_store, mixing, exact_dedup, hard_negatives, language, ranked)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
