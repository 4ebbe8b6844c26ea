"""Curation of media features, vectors and text at scale, on Spark."""
