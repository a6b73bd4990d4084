"""Structured Streaming forms of the stream summaries."""
