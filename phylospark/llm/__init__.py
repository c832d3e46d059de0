"""Operators for training data. Nothing outside of this package imports it."""
