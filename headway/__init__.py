"""Headway: transit-style event analytics as DataFrame and Structured Streaming transformations."""
