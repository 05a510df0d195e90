"""Registry of the analytics queries and their SQL counterparts."""

from __future__ import annotations

from ..operators import activity, catalog, evaluation, folds, fulltext, graph, loads, outline, resolve, scoring, search, temporal, terms, texts, validation
from ..streaming import incremental, phases

_MODULES = (activity, catalog, temporal, graph, search, terms, fulltext, resolve, folds, scoring, evaluation, validation, texts, outline, loads, incremental, phases)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()} | {"stream_reviews": folds.SQL["sm2"]}
