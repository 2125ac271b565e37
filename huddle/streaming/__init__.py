"""Streaming entry points (incremental ingest of landed weekly payloads)."""
