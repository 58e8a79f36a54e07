"""Whole jobs composed from the operators, and the catalogue of checked queries."""
