"""Incremental counterparts of the batch operators."""
