"""Operators that a training-data pipeline needs."""
