"""All named queries of the library's operators, with their SQL."""

from genomespark.plans import feature_queries, interval_queries, sequence_queries, variant_queries

_BOOKS = [m.BOOK for m in (sequence_queries, interval_queries, feature_queries, variant_queries)]
QUERIES = {k: v for b in _BOOKS for k, v in b.queries.items()}
SQL = {k: v for b in _BOOKS for k, v in b.sql.items()}
