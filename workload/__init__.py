"""Checks of the operators on the sample tables: inputs, queries and their SQL equivalents."""
