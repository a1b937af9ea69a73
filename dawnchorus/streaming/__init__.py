"""Incremental ingestion of window batches."""
