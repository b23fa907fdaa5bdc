"""Readers and writers for tables, delimited text, logs and sectioned text."""
