"""Streaming: incremental signature refresh."""
