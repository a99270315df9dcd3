"""Column functions: oriented ids and sequences."""
