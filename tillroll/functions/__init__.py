"""Shared column expressions: ``metrics`` and ``countries``."""
