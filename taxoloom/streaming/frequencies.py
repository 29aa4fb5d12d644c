"""Term counts over a stream of documents, kept up to date by Structured Streaming.

The batch operators need whole-corpus counts; these two aggregates are the part of them that can be kept
incrementally. Both take a streaming (or batch) table of doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.corpus import words


def word_counts(docs: DataFrame) -> DataFrame:
    """word and its number of occurrences so far; state grows with the vocabulary."""
    return words(docs).groupBy("word").count()


def document_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and its number of words; with the update mode only changed documents are put out."""
    return words(docs).groupBy("doc_id").count().withColumnRenamed("count", "dl")
