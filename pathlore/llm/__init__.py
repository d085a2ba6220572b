"""Operators for building language-model training data from a table of documents."""
