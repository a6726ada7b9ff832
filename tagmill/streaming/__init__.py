"""Arriving texts."""
