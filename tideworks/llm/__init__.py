"""Operators for large text corpora, one module each; ``queries`` lists what the driver runs."""
