"""Spark jobs for bringing tables and event streams in."""
