"""Structured Streaming: live matches of a chain with forks."""
