"""All registered queries."""

from . import chain_queries, genome_queries, interval_queries, locus_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
