"""Queries of this subpackage and the SQL for those that SQL can express."""

from veriledger.llm import clustered, decontaminate, divergence, langid, log_bloom, merkle, ngram_join, packing, pseudonyms, substrings, suffix_dedup, url_filter, word_table

_MODULES = (ngram_join, pseudonyms, packing, suffix_dedup, langid, log_bloom, substrings, divergence, url_filter, decontaminate, word_table, clustered, merkle)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
