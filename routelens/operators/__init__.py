"""routelens.operators."""
