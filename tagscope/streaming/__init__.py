"""Structured Streaming ingest of compressed JSON drops (SRC5-8, STR1-2)."""
