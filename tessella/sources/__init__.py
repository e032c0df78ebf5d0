"""Schemas, delimited text, the columnar store, and conversion between them."""
