"""Structured Streaming forms of run loading, the timeline and resource impact."""
