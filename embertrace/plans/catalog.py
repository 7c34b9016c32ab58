"""All registered queries."""

from embertrace.plans import (  # noqa: F401  (importing registers their queries)
    correlation_queries,
    delivery_queries,
    detection_queries,
    source_queries,
    table_queries,
)
from embertrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
