"""The relational operators on unbounded input."""
