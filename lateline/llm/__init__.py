"""Operators that prepare training text: each module is one operator, ``queries`` registers them."""
