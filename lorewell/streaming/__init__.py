"""Structured Streaming forms of ingest, usage counting, alarms, rate limits and status tracking."""
