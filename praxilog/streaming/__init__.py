"""Attempts as they arrive."""
