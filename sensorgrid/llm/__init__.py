"""Operators for training data: texts, conversations and vectors.  Nothing else in the library imports this."""
