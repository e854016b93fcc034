"""Readers, writers and the survey tables derived from the test data."""
