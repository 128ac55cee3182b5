"""Readers, writers and trace tables."""
