"""Iterative landmark selection, built from the operators."""
