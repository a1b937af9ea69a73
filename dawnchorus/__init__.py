"""Spark-native analytics over windowed audio-model output.

Every operator takes DataFrames and returns DataFrames; nothing is executed
until the caller writes, except the small checks that must fail before a write
starts (see :mod:`dawnchorus.checks`).
"""
