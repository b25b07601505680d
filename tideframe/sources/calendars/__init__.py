"""Authored calendar definitions."""
