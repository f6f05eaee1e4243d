"""Normalise, score and report municipal land-use rules with PySpark."""
