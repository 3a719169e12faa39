"""Scoring of predictions as they arrive."""
