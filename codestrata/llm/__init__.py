"""Operators for preparing training text: each works on a table of documents of any size."""
