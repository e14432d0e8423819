"""Index build, search and the segment store."""
