"""Incremental and streaming jobs (W1-W6) on Structured Streaming."""
