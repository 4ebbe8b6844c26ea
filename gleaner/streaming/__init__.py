"""Structured Streaming over files that land one after another."""
