"""Whole studies and the query catalogue."""
