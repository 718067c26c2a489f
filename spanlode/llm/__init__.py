"""Operators that prepare code and notes as training text. Nothing outside this folder imports it."""
