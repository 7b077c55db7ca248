"""The queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from stormlane.llm import ann, bpe, decontamination, language_id, mixing, packing, pu, resampling, secret_scan, simhash, token_counts, vector_codes

_MODULES = (decontamination, packing, language_id, simhash, secret_scan, token_counts, pu, ann, bpe, vector_codes, mixing, resampling)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
