"""Whole queries over tables, by name, with their SQL."""
