"""Typed building blocks: literals, predicates, derived columns, aggregates."""
