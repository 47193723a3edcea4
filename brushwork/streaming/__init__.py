"""Structured Streaming operators over live feeds."""
