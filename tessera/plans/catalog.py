"""All registered queries with their SQL twins."""

from __future__ import annotations

from . import q_evaluate, q_hetero, q_prepare, q_split, q_state, q_stream  # noqa: F401  (they register themselves)
from .views import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
