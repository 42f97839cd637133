"""Whole flows, composed from the operators."""
