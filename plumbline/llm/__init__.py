"""Operators for text corpora: each module is one operator, ``queries`` registers them."""
