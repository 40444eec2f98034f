"""Structured Streaming twins of the batch jobs (alerts, thread findings)."""
