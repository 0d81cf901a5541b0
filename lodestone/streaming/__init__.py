"""Structured Streaming: change events, replay protection, late events, rate limits, dead letters."""
