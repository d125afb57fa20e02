"""Column functions on sequences and scores."""
