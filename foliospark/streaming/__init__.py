"""Structured Streaming operators over the task event log."""
