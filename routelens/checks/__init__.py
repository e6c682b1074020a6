"""routelens.checks."""
