"""Table to table jobs."""
