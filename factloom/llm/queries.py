"""Queries and oracle SQL of the training-data operators, for __spark_entry__.py."""

from factloom.llm import embedding_dedup, exact_dedup, jaccard_join, langid, line_dedup, lm, mixing, pieces, toxicity, warc

_MODULES = [toxicity, mixing, lm, exact_dedup, pieces, langid, line_dedup, jaccard_join, embedding_dedup, warc]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
