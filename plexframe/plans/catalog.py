"""Registered queries over the driver tables, and their SQL."""

from plexframe.plans import adapter_queries, consensus_queries, copy_queries, demux_queries, filter_queries, interval_queries, read_queries, record_queries, source_queries  # noqa: F401
from plexframe.plans.views import QUERIES, SQL  # noqa: F401
