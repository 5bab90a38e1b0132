"""Tripletide: knowledge-graph consistency analytics expressed as Spark plans."""
