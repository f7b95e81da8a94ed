"""Operators for the preparation of training text: ten of them, one module each."""
