"""Structured Streaming: continuous ingest, live tail, stateful limits, rolling counts."""
