"""Continuous forms of the operators that a stream can feed."""
