"""Traversal operators as data-frame joins."""
