"""Logical plans: networks from tables, the query catalog."""
