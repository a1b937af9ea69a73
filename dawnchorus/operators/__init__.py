"""Relational operators: framing, classification, scoring, labels, routing."""
