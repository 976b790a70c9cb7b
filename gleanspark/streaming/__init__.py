"""Incremental ingest and trends over streams."""
