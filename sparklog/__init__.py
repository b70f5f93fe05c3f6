"""Log analytics on Spark DataFrames: ingest, query, correlate, summarise, retain."""

from sparklog.schema import LOG_COLUMNS, LOG_SCHEMA
from sparklog.session import build_session, configure

__all__ = ["LOG_COLUMNS", "LOG_SCHEMA", "build_session", "configure"]
