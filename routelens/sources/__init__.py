"""routelens.sources."""
