"""Structured Streaming counterparts of the trace and advisory readers."""
