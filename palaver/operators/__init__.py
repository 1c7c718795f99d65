"""Operators over a posts table, each a function from DataFrame to DataFrame."""
