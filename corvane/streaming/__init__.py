"""Structured Streaming forms of the run-lifecycle operators."""
