"""Structured Streaming forms of the scoring and statistics jobs."""
