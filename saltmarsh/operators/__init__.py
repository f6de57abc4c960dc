"""Relational operators over messages."""
