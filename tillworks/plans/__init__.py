"""Whole reports and batch jobs composed from the operators."""
