"""Readers and generators of attempts."""
