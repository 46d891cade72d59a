"""Operators on caption relations (DataFrame -> DataFrame)."""
