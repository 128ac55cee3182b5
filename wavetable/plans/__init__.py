"""Composite detectors and denoisers, and the registry of queries."""
