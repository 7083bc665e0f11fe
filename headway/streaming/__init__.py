"""Structured Streaming: collection of feeds into guarded keyed tables."""
