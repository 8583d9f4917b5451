"""Operators for preparing language-model training data. Nothing else in lettermill imports this subpackage."""
