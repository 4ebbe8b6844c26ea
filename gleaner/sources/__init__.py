"""Files, pages, sessions and images as DataFrames."""
