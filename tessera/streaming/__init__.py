"""Ordered event streams of jobs as Structured Streaming queries."""
