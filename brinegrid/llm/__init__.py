"""Operators for training text and numeric training data. Nothing outside this subpackage imports it."""
