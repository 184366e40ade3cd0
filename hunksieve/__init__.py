"""Diff-scoped rule evaluation and training-data operators on PySpark."""
