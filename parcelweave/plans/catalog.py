"""All driver queries; importing this module registers them."""

from parcelweave.plans import (  # noqa: F401
    frontier_queries,
    metrics_queries,
    page_queries,
    record_queries,
    scoring_queries,
    stream_queries,
)
from parcelweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
