"""Operators for training data and the sketches that measure it. Nothing else in the library imports this package."""
