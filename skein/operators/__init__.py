"""Operators over assembly graphs."""
