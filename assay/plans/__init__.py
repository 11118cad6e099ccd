"""Whole jobs made of the operators, and the query catalog."""
