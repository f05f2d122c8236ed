"""Operators for preparing training data: one module each, plus the queries that apply them."""
