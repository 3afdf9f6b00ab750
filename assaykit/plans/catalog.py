"""All registered queries."""

from . import gate_queries, item_queries, metric_queries, more_queries, result_queries, source_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
