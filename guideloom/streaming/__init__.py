"""Searches over contigs that arrive as files; an addition to what the batch tool does."""
