"""Operators over string graphs."""
