"""Readers: file listings, staged tables, recognizer definitions, label lists."""
