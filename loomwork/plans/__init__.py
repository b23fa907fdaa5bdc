"""Whole jobs made from the operators."""
