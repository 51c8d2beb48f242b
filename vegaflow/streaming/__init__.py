"""Structured Streaming builds of the micro-batch work: bars, idempotent runs, completeness, sessions."""
