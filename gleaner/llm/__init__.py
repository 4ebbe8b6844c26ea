"""Operators for training-data pipelines over documents, conversations and pages."""
