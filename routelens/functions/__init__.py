"""routelens.functions."""
