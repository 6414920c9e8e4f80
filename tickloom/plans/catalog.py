"""All queries. Importing the modules registers them."""

from tickloom.plans import (  # noqa: F401
    bar_queries,
    indicator_queries,
    scan_queries,
    scoring_queries,
    signal_queries,
    source_queries,
    stream_queries,
    structure_queries,
    deal_queries,
)
from tickloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
