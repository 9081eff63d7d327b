"""Runnable catalogue: importing the modules below registers their queries."""

from zocalo.queries import (catalogue_queries, enrichment_queries, evaluation_queries, io_queries, memory_queries,  # noqa: F401
                            metric_queries, text_queries)
from zocalo.queries.registry import QUERIES, Query, query  # noqa: F401
