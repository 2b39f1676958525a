"""Slices of reports kept by streams."""
