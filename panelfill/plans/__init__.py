"""Composite jobs: matrices, rounds, reports."""
