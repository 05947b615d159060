"""Queries and oracle SQL of this subpackage, for the entry point."""

from __future__ import annotations

from . import queries_corpus, queries_dedup, queries_models, queries_shards, queries_texts, queries_tokens, queries_vectors, queries_windows

_MODULES = (queries_corpus, queries_dedup, queries_models, queries_shards, queries_tokens, queries_texts, queries_vectors, queries_windows)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
