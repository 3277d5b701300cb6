"""Operators on keyed tables and their changes."""
