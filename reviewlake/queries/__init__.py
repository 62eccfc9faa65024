"""Registered queries by survey section."""

from reviewlake.queries import (  # noqa: F401
    search_queries,
    function_queries,
    predicate_queries,
    join_queries,
    aggregate_queries,
    rank_queries,
    findings_queries,
    composite_queries,
    source_queries,
)
from reviewlake.queries.registry import QUERIES, SQL  # noqa: F401
