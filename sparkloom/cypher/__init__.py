"""The query language: text to syntax trees."""
