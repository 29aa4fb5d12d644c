"""Readers and writers of the text, CSV, JSON and Parquet formats."""
