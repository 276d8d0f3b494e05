"""Reports and files that results are written to."""
