"""Operators for corpora of texts and vectors. Nothing else in the library imports this subpackage."""
