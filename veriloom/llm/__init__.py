"""Operators on text and labels for training data; nothing outside this package imports it."""
