"""All registered queries."""

from tarmac.plans import (  # noqa: F401
    queries_documents,
    queries_joins,
    queries_models,
    queries_rows,
    queries_rules,
    queries_search,
    queries_sources,
    queries_streaming,
)
from tarmac.plans.registry import QUERIES

__all__ = ["QUERIES"]
