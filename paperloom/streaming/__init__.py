"""Structured Streaming around the same operators."""
