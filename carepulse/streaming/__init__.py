"""Structured Streaming intake jobs."""
