"""Expressions of the language as Spark columns."""
