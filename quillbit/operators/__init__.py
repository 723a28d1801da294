"""Relational operators: models, aggregates, joins, sampling and reports."""
