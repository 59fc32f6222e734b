"""Structured Streaming over growing ledgers and events."""
