"""Column builders: rule vocabularies and text functions."""
