"""Operators for large training corpora. Nothing outside this package imports it, except the entry module's guard."""
