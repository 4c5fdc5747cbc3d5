"""Locating, evaluating, masking and reporting supplied sensitive values in large document collections, on Spark."""
