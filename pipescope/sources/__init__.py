"""Readers, writers and the views studies start from."""
