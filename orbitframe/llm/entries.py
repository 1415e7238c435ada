"""The registered queries of this folder and their SQL oracles."""

from __future__ import annotations

from orbitframe.llm import queries_rows, queries_scores, queries_text, queries_vectors

QUERIES = queries_text.QUERIES | queries_scores.QUERIES | queries_vectors.QUERIES | queries_rows.QUERIES
ORACLES = queries_text.ORACLES | queries_scores.ORACLES | queries_vectors.ORACLES | queries_rows.ORACLES
