"""Operators on long trace tables."""
