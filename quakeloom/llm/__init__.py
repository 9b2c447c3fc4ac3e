"""Operators for building training data out of large text collections."""
