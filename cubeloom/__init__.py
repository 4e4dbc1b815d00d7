"""Gridded time-series analytics as DataFrame operators."""
