"""routelens.streaming."""
