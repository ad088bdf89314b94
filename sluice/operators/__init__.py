"""Operators on flow networks: algebra, exact solvers, partitioners, dual decomposition, decoding."""
