"""Tables as reports, and action plans for files."""
