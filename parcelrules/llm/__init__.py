"""Operators a training-data pipeline needs, and the queries that apply them."""
